"""Options of set, getex, hsetex and hgetex, and dictionaries that a replica is sent."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexikv.operators import hashes, strings
from lexikv.sources import manifest

T0 = dt.datetime(2024, 1, 1)
LOG = "seq long, ts timestamp_ntz, cmd string, key string, value string, ttl long, cond string, unit string"


def _until(at, unit, n):
    unit = (unit or "").upper()
    start = {"EX": at, "PX": at, "EXAT": dt.datetime(1970, 1, 1), "PXAT": dt.datetime(1970, 1, 1)}.get(unit)
    return None if start is None or n is None else start + dt.timedelta(milliseconds=n if unit.startswith("PX") else 1000 * n)


def test_options_follow_each_command(spark):
    rng = random.Random(4)
    log = [
        (i, T0 + dt.timedelta(minutes=i), rng.choice(["set", "set", "getex", "getdel", "append", "get"]), rng.choice([*"abc", None]), "v",
         rng.choice([5, 70_000]), rng.choice(["NX", "xx", None]), rng.choice(["EX", "px", "EXAT", "PXAT", "KEEPTTL", "PERSIST", None]))
        for i in range(600)
    ]
    there, until, expected = {}, {}, []
    for seq, ts, cmd, key, _, ttl, cond, unit in log:
        written = cmd == "set" and (cond is None or there.get(key, False) == (cond == "xx"))
        if written and unit != "KEEPTTL" or cmd == "getex" and unit not in (None, "KEEPTTL"):
            until[key] = _until(ts, unit, ttl)
        if cmd == "getdel":
            there[key], until[key] = False, None
        elif written or cmd == "append":
            there[key] = True
        expected.append((seq, written, until.get(key)))
    found = strings.options(spark.createDataFrame(log, LOG)).select("seq", "written", "expire_at").orderBy("seq").collect()
    assert [tuple(r) for r in found] == expected
    assert strings.options(spark.createDataFrame([], LOG)).count() == 0


def test_hsetex_conditions_and_expiry(spark):
    store = spark.createDataFrame([("k", "a", "1", T0), ("k", "b", "", None)], "key string, field string, value string, expire_at timestamp_ntz")
    writes = spark.createDataFrame(
        [
            (1, T0, "k", "a", "x", "FNX", None, None), (1, T0, "k", "n", "x", "FNX", None, None),  # has a: nothing
            (2, T0, "k", "a", "2", "fxx", "KEEPTTL", None), (2, T0, "k", "b", "2", "fxx", "KEEPTTL", None),
            (3, T0, "k", "c", "3", "FNX", "EX", 60), (4, T0, "k", "d", "4", "FXX", None, None), (5, T0, "k", "e", "5", None, "px", 500),
        ],
        "request long, ts timestamp_ntz, key string, field string, value string, cond string, unit string, ttl long",
    )
    after, replies = hashes.hsetex(writes, store)
    assert {r.request: r.reply for r in replies.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}
    assert {(r.field, r.value, r.expire_at) for r in after.collect()} == {
        ("a", "2", T0), ("b", "2", None), ("c", "3", T0 + dt.timedelta(minutes=1)), ("e", "5", T0 + dt.timedelta(milliseconds=500)),
    }


def test_hgetex_reads_and_changes_expiry(spark):
    store = spark.createDataFrame([("k", "a", "1", T0), ("k", "b", "", T0), ("k", "c", "3", T0)], "key string, field string, value string, expire_at timestamp_ntz")
    asked = spark.createDataFrame(
        [(1, T0, "k", "a", "EX", 9), (2, T0, "k", "a", "PERSIST", None), (3, T0, "k", "a", None, None), (4, T0, "k", "b", None, None), (5, T0, "k", "z", "EX", 1)],
        "request long, ts timestamp_ntz, key string, field string, unit string, ttl long",
    )
    replies, after = hashes.hgetex(asked, store)
    assert {r.request: r.value for r in replies.collect()} == {1: "1", 2: "1", 3: "1", 4: None, 5: None}
    assert {r.field: r.expire_at for r in after.collect()} == {"a": None, "b": T0, "c": T0}


def test_published_dictionaries_stay_in_their_directory(spark):
    text = b"id = 7\ndict_file = /x/good.dict\nnamespaces = a, b\ncreated = 2024-01-01T00:00:00Z\n"
    bad = ["", None, "..", ".good", "../good", "a/good", "a\\good", "good\0"]
    sent = [(1, "lm", "good", text), (2, "ld", "good", b"old"), (3, "ld", "good", b"new"), (4, "lm", "alone", text.replace(b"good", b"alone")), (5, "ld", "none", None)]
    sent += [(10 + i, "ld", b, b"evil") for i, b in enumerate(bad)]
    replies, found = manifest.load_published(spark.createDataFrame(sent, "seq long, cmd string, base string, data binary"))
    assert {r.seq for r in replies.filter(F.col("reply") == "OK").collect()} == {1, 2, 3, 4}
    assert replies.count() == len(sent)
    assert [(r.id, r.uuid, bytes(r.dict), r.namespaces) for r in found.collect()] == [(7, "good", b"new", ["a", "b"])]
