"""Log operators against a plain store over random logs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexikv.operators import strings
from lexikv.streaming.store import apply_command


def random_log(spark):
    """A log, each command's (before, after) and what the keys hold at the end with their time, from a plain store."""
    rng, t = random.Random(11), dt.datetime(2024, 1, 1)
    cmds = ["set", "setex", "setnx", "append", "append", "get", "getdel", "getset", "del"]
    log = [(i * 3, t, rng.choice(cmds), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(["", f"v{i}."]), rng.choice([None, 5, 50])) for i in range(500)]
    log += [(2000 + i, t, c, k, f"w{i}", 5) for i, (c, k) in enumerate([("setnx", "nx"), ("append", "nx"), ("append", "ap"), ("set", "gone"), ("getdel", "gone"), ("set", "late"), ("append", "late")])]
    held, times, around = {}, {}, {}
    for seq, _, cmd, key, value, ttl in log:
        before = held.get(key)
        held[key], _ = apply_command(cmd, before, value)
        times[key] = None if held[key] is None else ttl if cmd in strings.WRITES else times.get(key)
        around[seq] = (before, held[key])
    df = spark.createDataFrame(log, "seq long, ts timestamp, cmd string, key string, value string, ttl long").repartition(5)
    return log, df, around, {k: (v, times[k]) for k, v in held.items() if v is not None}


def test_reads_equal_a_plain_store(spark):
    log, df, around, held = random_log(spark)
    before = {seq: b for seq, (b, _) in around.items()}
    for chunk in (7, 65_536):
        assert {r.seq: r.before for r in strings._before(df, chunk).collect()} == before
    of = lambda *cmds: {x[0]: before[x[0]] for x in log if x[2] in cmds}
    assert {r.seq: r.value for r in strings.get_as_of(df).collect()} == of("get")
    assert {r.seq: r.previous for r in strings.getset_previous(df).collect()} == of(*strings.WRITES)
    assert {r.key: r.value for r in strings.final_state(df).collect()} == {k: v for k, (v, _) in held.items()}
    assert {"nx", "ap", "late"} <= set(held)
    live = strings.ttl_live(df, F.to_timestamp(F.lit("2024-01-01 00:00:10")))
    assert {r.key: r.value for r in live.collect()} == {k: v for k, (v, t) in held.items() if t is None or t > 10}


def windows_over_whole_keys(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "windowspecdefinition" in x and "_chunk" not in x]


def test_replies_and_replay_see_a_key_in_chunks(spark):
    log, df, around, _ = random_log(spark)
    assert {r.seq: (r.before, r.after) for r in strings.replay(df).collect()} == around
    assert {r.seq: r.value for r in strings.getdel_replies(df).collect()} == {x[0]: around[x[0]][0] for x in log if x[2] == "getdel"}
    assert {r.seq: r.reply for r in strings.setnx_replies(df).collect()} == {x[0]: int(around[x[0]][0] is None) for x in log if x[2] == "setnx"}
    for out in (strings.replay(df), strings.getdel_replies(df), strings.setnx_replies(df)):
        assert not windows_over_whole_keys(out)
    assert "collect_list" not in strings.setnx_replies(df)._jdf.queryExecution().optimizedPlan().toString()
