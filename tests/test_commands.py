import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.operators import admin, codec, efficiency, hashes, ordered, registry, rewrite, routing, sampling, stats, strings, training
from lexikv.sources import manifest, spool
from lexikv.streaming import store


def _values(spark, values):
    return spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, v binary")


def _round_trip(spark, values, config=Config(), dictionaries=None, used=0):
    c = codec.Codec(spark, config, dictionaries)
    rows = _values(spark, values).select("i", c.encode(F.col("v"), used).alias("e"))
    out = rows.select("i", "e", c.decode(F.col("e.stored")).alias("d")).orderBy("i").collect()
    return [(None if r.d is None or r.d.value is None else bytes(r.d.value), r.e, r.d) for r in out]


def test_codec_sizes(spark):
    config = Config(max_comp_size=4096)
    sizes = [0, 1, 31, 32, 33, 4095, 4096, 4097]
    values = [b"A" * n for n in sizes] + [os.urandom(n) for n in sizes] + [None]
    out = _round_trip(spark, values, config)
    assert [x[0] for x in out] == values
    for n, (_, e, d) in zip(sizes * 2, out, strict=False):
        if n < 32 or n > 4096:
            assert e.outcome == ("skip_min" if n < 32 else "skip_max")
            assert len(e.stored) == n
            assert d.status == "raw"
    assert out[5][1].outcome == "encoded"
    assert len(out[5][1].stored) < 4095
    assert out[12][1].outcome == "skip_incomp"
    assert out[-1][1] is None


def test_codec_switches(spark):
    out = _round_trip(spark, [b"A" * 100], Config(enable_comp=False))
    assert (out[0][1].outcome, bytes(out[0][1].stored)) == ("disabled", b"A" * 100)


def test_dictionary_codec_and_heal(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "user_id", "session"]) + str(rng.randint(0, 99)) for _ in range(20))).encode() for _ in range(600)]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "seq long, value binary")
    made = training.train(df, Config(dict_size=4096))
    assert made == training.train(df, Config(dict_size=4096))
    assert len(made) >= 1024
    with pytest.raises(training.TrainingError):
        training.train(df.limit(1), Config(dict_size=4096))
    with_it, without = _round_trip(spark, texts[:50], dictionaries={7: made}, used=7), _round_trip(spark, texts[:50])
    assert [x[0] for x in with_it] == texts[:50]
    assert sum(x[1].clen for x in with_it) < sum(x[1].clen for x in without)
    stored = [bytes(x[1].stored) for x in with_it[:2]]
    bad = [stored[0], stored[1][:9] + b"\xff" * 8 + stored[1][17:], b"plain"]
    rows = _values(spark, bad).withColumn("decoded", codec.Codec(spark).decode(F.col("v")))
    assert [r.decoded.status for r in rows.orderBy("i").collect()] == ["dict_miss", "dict_miss", "raw"]
    rows = _values(spark, bad).withColumn("decoded", codec.Codec(spark, dictionaries={7: made}).decode(F.col("v")))
    assert [r.decoded.status for r in rows.orderBy("i").collect()] == ["ok", "corrupt", "raw"]
    clean, gone = codec.split_healed(rows, ["i"])
    assert sorted(r.i for r in clean.collect()) == [0, 2]
    assert [r.i for r in gone.collect()] == [1]
    assert codec.split_healed(rows, ["i"], replica=True)[1].count() == 0
    with pytest.raises(ValueError, match="ids"):
        codec.Codec(spark, dictionaries={0: made})


def test_ranges(spark):
    rows = _values(spark, [b"hello", b"", None])
    out = rows.select("i", codec.byte_range(F.col("v"), 1, 3).alias("a"), codec.byte_range(F.col("v"), -3, -1).alias("b"), codec.byte_range(F.col("v"), 4, 2).alias("c"), codec.set_range(F.col("v"), 7, F.lit(b"XY")).alias("d"), codec.set_range(F.col("v"), 0, F.lit(b"J")).alias("e"), codec.append_raw(F.col("v"), F.lit(b"!")).alias("f")).orderBy("i").collect()
    plain = [tuple(None if x is None else bytes(x) for x in r[1:]) for r in out]
    assert plain[0] == (b"ell", b"llo", b"", b"hello\0\0XY", b"Jello", b"hello!")
    assert plain[1] == (b"", b"", b"", b"\0" * 7 + b"XY", b"J", b"!")
    assert plain[2] == (None, None, None, b"\0" * 7 + b"XY", b"J", b"!")


def test_routing(spark):
    keys = [("doc:en:1", "doc:en:"), ("doc:en:", "doc:en:"), ("doc:e", "doc:"), ("do", "default"), ("", "default"), ("other", "default"), (None, None)]
    df = spark.createDataFrame([(k,) for k, _ in keys], "key string")
    assert dict(df.select("key", routing.route(F.col("key"), ["doc:", "doc:en:", "page:"])).collect()) == dict(keys)
    many = spark.createDataFrame([("doc:",), ("doc:en:",), (None,), ("",), ("default",)] + [(f"p{i}:",) for i in range(300)], "ns string")
    assert dict(routing.route_by(df, many).collect()) == dict(keys)


LOG = "seq long, ts timestamp, cmd string, key string, value string, ttl long"


def _model(log):
    """A plain store: (before, after) of each command."""
    held, out = {}, []
    for seq, _, cmd, key, value, _ in sorted(log):
        before = held.get(key)
        after, _ = store.apply_command(cmd, before, value)
        held[key] = after
        out.append((seq, before, after))
    return out


def test_replay_equals_a_plain_store(spark):
    rng = random.Random(3)
    log = [(i, dt.datetime(2024, 1, 1), rng.choice(["set", "setnx", "append", "get", "getdel", "getset", "del"]), f"k{rng.randint(0, 5)}", f"v{i}", None) for i in range(400)]
    out = strings.replay(spark.createDataFrame(log, LOG)).orderBy("seq").collect()
    assert [(r.seq, r.before, r.after) for r in out] == _model(log)
    assert strings.replay(spark.createDataFrame([], LOG)).count() == 0


def test_carry_last(spark):
    rng = random.Random(9)
    rows = [(i * 2, rng.choice(["a", "b", None]), rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, key string, v long")
    for chunk in (7, 65_536):
        for inclusive in (False, True):
            held, want = {}, {}
            for seq, key, v in rows:
                if not inclusive:
                    want[seq] = held.get(key)
                held[key] = held.get(key) if v is None else v
                if inclusive:
                    want[seq] = held.get(key)
            out = ordered.carry_last(df, "key", "seq", F.col("v"), "last", inclusive, chunk)
            assert {r.seq: r.last for r in out.collect()} == want


def test_string_lookups(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "")], "key string, value string")
    asked = spark.createDataFrame([(1, ["b", "zz", "a", "b"]), (2, []), (3, None)], "request int, keys array<string>")
    assert {r.request: r["values"] for r in strings.mget(asked, held).collect()} == {1: ["", None, "1", ""], 2: [], 3: []}
    assert {r.request: r["values"] for r in strings.mget(asked, held, empty_is_null=True).collect()}[1] == [None, None, "1", None]
    pairs = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "new", "y"), (2, 3, "c", "z"), (2, 4, "c", "w")], "request int, pos int, key string, value string")
    assert dict(strings.mset(pairs).collect()) == {"a": "x", "new": "y", "c": "w"}
    assert {r.request for r in strings.msetnx(pairs, held).collect()} == {2}


def test_expiry(spark):
    t = dt.datetime(2024, 1, 1)
    log = [(1, t, "set", "a", "x", 10), (2, t, "set", "b", "y", None), (3, t, "getex", "b", None, 5), (4, t, "getex", "a", None, None)]
    df = spark.createDataFrame(log, LOG)
    assert {r.key for r in strings.ttl_live(df, F.to_timestamp(F.lit("2024-01-01 00:00:11"))).collect()} == {"b"}
    assert [r.expire_at for r in strings.getex(df).orderBy("seq").collect()] == [t + dt.timedelta(seconds=10), None, t + dt.timedelta(seconds=5), None]


def test_hash_commands(spark):
    held = spark.createDataFrame([("h", "a", "1"), ("h", "b", ""), ("g", "c", "3")], "key string, field string, value string")
    asked = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "zz")], "key string, field string")
    assert {r.field: r.value for r in hashes.hget(asked, held).collect()} == {"a": "1", "b": None, "zz": None}
    multi = spark.createDataFrame([(1, "h", ["zz", "b", "a"])], "request int, key string, fields array<string>")
    assert hashes.hmget(multi, held).first()["values"] == [None, "", "1"]
    assert hashes.hmget(multi, held, empty_is_null=True).first()["values"] == [None, None, "1"]
    assert {r.key: r["values"] for r in hashes.hvals(held).collect()} == {"h": ["1", None], "g": ["3"]}
    writes = spark.createDataFrame([(1, "h", "a", "x"), (2, "h", "n", "y"), (3, "h", "n", "z")], "seq long, key string, field string, value string")
    merged, replies = hashes.hset(writes, held)
    assert {(r.key, r.field): r.value for r in merged.collect()} == {("h", "a"): "x", ("h", "b"): "", ("g", "c"): "3", ("h", "n"): "z"}
    assert dict(replies.collect()) == {"h": 1}
    assert [r.reply for r in hashes.hsetnx(writes, held).orderBy("seq").collect()] == [0, 1, 0]
    _, left = hashes.hgetdel(asked, held)
    assert [r.key for r in left.collect()] == ["g"]
    assert hashes.hrandfield(held, 1).count() == 2


def test_rewrite(spark):
    rows = spark.createDataFrame([("get", 2, "k"), ("HMSET", 4, "k"), ("mget", 2, "k"), ("GET", 1, "k"), ("SET", 3, "dict:1"), ("SET", 3, "DICT:1"), ("ZADD", 4, "k"), ("hsetex", 3, "k"), ("get", 2, None)], "cmd string, argc int, key string")
    on = Config(enable_string_filter=True, enable_hash_filter=True, enable_async_cmd=True)
    got = lambda c, **k: [r[0] for r in rows.select(rewrite.rewrite(F.col("cmd"), F.col("argc"), F.col("key"), c, **k)).collect()]
    assert got(on) == ["get", "hsetasync", "mgetasync", "GET", "SET", "set", "ZADD", "hsetex", "get"]
    assert got(Config(enable_string_filter=True))[1:3] == ["HMSET", "mget"]
    assert got(on, field_expiry=False)[7] == "hsetex"
    assert got(Config()) == [r.cmd for r in rows.collect()]
    loads = spark.createDataFrame([("HSET", ["dict:1", "file_name", "x", "data", "y"], "Dict:1", "replica"), ("hset", ["dict:1:mf", "data", "x", "FILE_NAME", "y"], "dict:1:mf", "replica"), ("HSET", ["dict:1", "file_name", "x", "data", "y"], "dict:1", "master")], "cmd string, args array<string>, key string, role string")
    assert [r[0] for r in loads.select(rewrite.dictionary_load(F.col("cmd"), F.col("args"), F.col("key"), F.col("role"))).collect()] == ["ld", "lm", None]


def test_efficiency_equals_a_fold(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.randint(0, 50), rng.randint(0, 60)) for i in range(500)]
    e = base = None
    size = n = 0
    for _, raw, cmp in rows:
        if raw:
            s = cmp / raw
            e, base = (s, s) if e is None else (0.2 * s + 0.8 * e, base)
            size, n = size + raw, n + 1
    for chunk in (7, 65_536):
        r = efficiency.track(spark.createDataFrame(rows, "seq long, raw long, cmp long"), 0.2, chunk=chunk).first()
        assert (r.observations, r.bytes) == (n, size)
        assert r.ewma == pytest.approx(e, abs=1e-9)
        assert r.baseline == pytest.approx(base)
    assert efficiency.track(spark.createDataFrame([], "seq long, raw long, cmp long"), 0.2).count() == 0


def test_registry(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a", bytearray(b"x"), ["n1"], t(1), None, 3, None, 10), (2, "b", bytearray(b"y"), ["n1", "n2"], t(2), None, 3, None, 20), (3, "c", bytearray(b"z"), ["n1"], t(2), None, 3, None, 30), (5, "d", None, [], t(1), t(3), 3, None, 40), (None, "e", bytearray(b"q"), None, t(4), None, 3, None, 50)]
    r = spark.createDataFrame(rows, registry.SCHEMA)
    assert {(x.ns, x.id) for x in registry.ranked(r).filter("rank = 1").collect()} == {("n1", 3), ("n2", 2), ("default", None)}
    assert {x.id for x in registry.overflow(r, 1).collect()} == {1}
    assert [x.id for x in registry.next_ids(r, 3).orderBy("k").collect()] == [4, 6, 7]
    assert {x.uuid: x.id for x in registry.assign_ids(r).collect()}["e"] == 4
    gone = registry.garbage(r, F.to_timestamp(F.lit("2024-01-11")), 7 * 86400)
    assert [x.id for x in gone.collect()] == [5]
    assert registry.garbage(r, F.to_timestamp(F.lit("2024-01-09")), 7 * 86400).count() == 0
    assert registry.garbage(r, F.to_timestamp(F.lit("2024-01-11")), 7 * 86400, r.filter("id = 5")).count() == 0
    retired = registry.retire(r, spark.createDataFrame([(1,), (5,)], "id int"), F.to_timestamp(F.lit("2024-02-01")))
    assert {x.id: x.retired for x in retired.filter("id in (1, 5)").collect()} == {1: dt.datetime(2024, 2, 1), 5: t(3)}
    assert tuple(registry.reload_diff(r.filter("id in (1, 2)"), r.filter("id in (2, 3, 5)")).first()) == (2, 3, 2, 1, 1, 1)
    assert registry.load(r) == {1: b"x", 2: b"y", 3: b"z"}
    assert [x.valid for x in registry.signature_holds(registry.signed(r.filter("id = 1"))).collect()] == [True]
    assert [x.ns for x in stats.namespaces(r).collect()][0] == "global"


def test_manifests(spark, tmp_path):
    text = "# comment\nid=42\ncreated=2025-01-01T00:00:00Z\ndict_file=/var/lib/dict_42.dict\nnamespaces=a, b\nlevel=1\nsignature=abcdef\n"
    (tmp_path / "one.mf").write_text(text)
    (tmp_path / ".hidden.mf").write_text(text)
    (tmp_path / "bad.mf").write_text("id=x\ndict_file=dict_42.dict\n")
    (tmp_path / "dict_42.dict").write_bytes(b"content")
    (row,) = manifest.read_registry(spark, str(tmp_path)).collect()
    assert (row.id, row.uuid, bytes(row.dict), row.namespaces, row.level) == (42, "dict_42", b"content", ["a", "b"], 1)
    back = manifest.parse_manifests(manifest.read_registry(spark, str(tmp_path)).select(F.col("uuid").alias("path"), manifest.render_manifest().alias("value"))).first()
    assert (back.id, back.namespaces, back.created, back.signature, back.valid) == (42, ["a", "b"], row.created, "abcdef", True)
    few = manifest.parse_manifests(spark.createDataFrame([("p", ""), ("q", None)], "path string, value string")).collect()
    assert [r.namespaces for r in few] == [["default"], ["default"]]


def test_spool(spark, tmp_path):
    spool.register(spark)
    rows = [(b"k1", b"value"), (b"", b"x"), (b"k3", b""), (b"k4", b"y" * 100_000)]
    path = f"file://{tmp_path}/spool"
    spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary").write.format("kvspool").mode("append").save(path)
    read = lambda p: sorted((bytes(r.key), bytes(r.value)) for r in spark.read.format("kvspool").load(p).collect())
    assert read(path) == sorted(rows)
    (tmp_path / "cut.bin").write_bytes(spool.pack_record(b"a", b"b") + spool.pack_record(b"c", b"d")[:-1])
    assert read(f"file://{tmp_path}/cut.bin") == [(b"a", b"b")]


def test_sampling(spark):
    rows = spark.createDataFrame([(i, 40 + i % 50) for i in range(300)], "seq long, len long")
    total, k = 0, 0
    for i in range(300):
        if total + 40 + i % 50 > 2500 or k >= 25:
            break
        total, k = total + 40 + i % 50, k + 1
    assert tuple(sampling.warm_up(rows, 2500).first()) == (k, total)
    assert sampling.reservoir(rows, 10, seed=1).count() == 10
    kv = spark.createDataFrame([(i, f"k{i}", "v" * (i % 7)) for i in range(200)], "seq long, key string, value string")
    out = sampling.spool_records(kv, Config(sample_p=1.0, spool_max_bytes=500)).orderBy("seq").collect()
    sizes = [8 + len(r.key) + len(r.value) for r in out]
    assert sum(sizes[:-1]) < 500 <= sum(sizes)
    assert sampling.spool_records(kv, Config(enable_sampling=False)).count() == 0


def test_admin_frames(spark):
    assert {r.name: r.value for r in admin.config_frame(spark, Config()).collect()}["enable_comp"] == "true"
    rows = spark.createDataFrame([("global", 3), ("default", 2)], "ns string, writes_total long")
    assert admin.stats_of(rows, None).first().writes_total == 3
    assert admin.stats_of(rows, "globalx").count() == 0
    assert admin.stats_of(rows, "default").select(admin.as_json()).first()[0] == '{"ns":"default","writes_total":2}'
    assert admin.role_frame(spark, "master", ["a", "b"]).first().flags == "a,b"


def test_stats(spark):
    c = codec.Codec(spark, Config(max_comp_size=200))
    rows = spark.createDataFrame([("a", bytearray(b"x" * 100)), ("a", bytearray(b"y")), ("b", bytearray(b"z" * 300))], "ns string, v binary").select("ns", F.octet_length("v").alias("raw_size"), c.encode(F.col("v")).alias("encoded"))
    out = {r.ns: r for r in stats.write_counters(rows).collect()}
    assert (out["global"].writes_total, out["global"].bytes_raw_total, out["a"].skipped_min, out["b"].skipped_max) == (3, 401, 1, 1)
    assert 0 < out["a"].bytes_cmp_total < 100
    assert out["b"].bytes_cmp_total == 0
