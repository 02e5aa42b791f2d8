import datetime as dt
import time

from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.operators import admin, hashes, sampling, stats, strings
from lexikv.streaming.sampler import Sampler

T = dt.datetime(2024, 1, 1)
ROWS = "seq long, ts timestamp, key string, value string, ns string"


def _rows(spark, n, step=10):
    return spark.createDataFrame([(i, T + dt.timedelta(seconds=step * i), f"k{i:03}", "some plain text to keep " * 4, "default") for i in range(n)], ROWS)


def test_windows_hold_what_comes_in_time(spark):
    rows = _rows(spark, 20)
    config = Config(sample_p=1.0, sample_window_duration=50, training_window_duration=30)
    assert {r.seq for r in sampling.spool_records(rows, config, ts="ts").collect()} == {0, 1, 2, 3, 4}
    assert {r.seq for r in sampling.training_feed(rows, config, ts="ts").collect()} == {0, 1, 2}
    assert sampling.spool_records(rows, config).count() == 20
    assert sampling.spool_records(rows.limit(0), config, ts="ts").count() == 0


def test_sampler_starts_once_and_stops_at_its_cap(spark, tmp_path):
    rows = _rows(spark, 30)
    size = 8 + 4 + len(rows.first().value)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    sampler = Sampler(spark, Config(sample_p=1.0, spool_max_bytes=10 * size - 1, spool_dir=str(tmp_path / "spool")))
    assert sampler.stop() == 1
    assert sampler.status() == {"configured": True, "running": False, "bytes_written": 0, "path": ""}
    assert sampler.start(stream, "0 seconds") == 0
    assert sampler.start(stream) == 1
    until = time.time() + 60
    while sampler.written == 0 and time.time() < until:
        time.sleep(0.2)
    assert sampler.status()["running"]
    assert sampler.stop() == 0
    assert not sampler.running
    assert sampler.written == 10 * size
    held = spark.read.format("kvspool").load(sampler.path).select(F.col("key").cast("string"))
    assert sorted(r.key for r in held.collect()) == [f"k{i:03}" for i in range(10)]


def test_getex_renews_only_what_is_there(spark):
    log = [
        (1, T, "getex", "a", None, 5), (2, T, "setnx", "a", "x", None), (3, T, "set", "b", "y", 10), (4, T, "getex", "b", None, 100), (5, T, "append", "b", "z", None),
        (6, T, "setnx", "c", "n", None), (7, T, "getex", "c", None, 7), (8, T, "set", "d", "m", 10), (9, T, "getex", "d", None, None), (10, T, "set", "e", "m", 90),
        (11, T, "getex", "e", None, 5), (12, T, "del", "e", None, None), (13, T, "append", "e", "w", None),
    ]
    df = spark.createDataFrame(log, "seq long, ts timestamp, cmd string, key string, value string, ttl long")
    out = {r.key: (r.value, r.expire_at) for r in strings.ttl_live(df, F.lit(T), renewals=True).collect()}
    at = lambda s: T + dt.timedelta(seconds=s)
    assert out == {"a": ("x", None), "b": ("yz", at(100)), "c": ("n", at(7)), "d": ("m", None), "e": ("w", None)}


def test_repeated_random_fields(spark):
    held = spark.createDataFrame([("k", str(i), f"v{i}") for i in range(3)] + [("one", "f", "v")], "key string, field string, value string")
    out = hashes.hrandfield(held, -200, seed=1).collect()
    drawn = [r.field for r in out if r.key == "k"]
    assert len(drawn) == 200
    assert all(40 < drawn.count(str(i)) < 95 for i in range(3))
    assert all(r.value == f"v{r.field}" for r in out if r.key == "k")
    assert [r.field for r in out if r.key == "one"] == ["f"] * 200


def test_entries_in_order(spark):
    counted = stats.training_counters(spark.createDataFrame([("n", 1, "rise", False, 7), ("n", 2, None, True, 9), ("m", 3, "drop", None, 4)], "ns string, seq long, trigger string, failed boolean, ms long"))
    found = {r.ns: (r.triggers_rise, r.triggers_drop, r.trainer_errs, r.trainer_ms_last) for r in counted.collect()}
    assert found == {"n": (1, 0, 1, 9), "m": (0, 1, 0, 4), "global": (1, 1, 1, 4)}
    assert len(admin.ENTRIES) == len(set(admin.ENTRIES)) == 34
