"""Settings and inputs that must be refused or survived, not cut."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.functions.header import id_bytes
from lexikv.operators import codec, registry, strings, training
from lexikv.sources import manifest, spool


def test_a_header_that_claims_too_much_is_corrupt(spark):
    # a frame with an eight-byte content size of 2**42
    frame = b"\x28\xb5\x2f\xfd" + bytes([0b11100000]) + struct.pack("<Q", 1 << 42) + b"\x01\x00\x00"
    rows = spark.createDataFrame([(bytearray(frame),)], "frame binary").select(F.concat(id_bytes(F.lit(0)), "frame").alias("stored"))
    got = rows.select(codec.Codec(spark).decode(F.col("stored")).alias("d")).select("d.*").first()
    assert (got.value, got.status) == (None, codec.CORRUPT)


def test_ids_that_run_out_are_an_error(spark):
    new = spark.range(registry.MAX_ID).select(F.lit(None).cast("int").alias("id"), F.col("id").cast("string").alias("uuid"), F.lit(None).cast("binary").alias("dict"), F.array(F.lit("a")).alias("namespaces"), F.lit(dt.datetime(2024, 1, 1)).alias("created"), F.lit(None).cast("timestamp").alias("retired"), F.lit(3).alias("level"), F.lit("").alias("signature"), F.lit(1).cast("long").alias("dict_size"))
    assert registry.assign_ids(new).agg(F.countDistinct("id")).first()[0] == registry.MAX_ID
    with pytest.raises(ValueError, match="want an id"):
        registry.publish(new, new.limit(1))


def test_training_refuses_more_than_it_samples():
    with pytest.raises(training.TrainingError, match="asked for"):
        training.budget(Config(min_training_size=training.MAX_SAMPLE_BYTES + 1))
    assert training.budget(Config(min_training_size=100 << 20)) == 100 << 20


def test_saved_registry_is_old_or_new(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    with pytest.raises(ValueError, match="no saved registry"):
        manifest.saved_registry(spark, path)
    row = (1, "u", bytearray(b"d"), ["a"], dt.datetime(2024, 1, 1), None, 3, None, 1)
    old, new = (spark.createDataFrame([row] * n, registry.SCHEMA) for n in (1, 2))
    manifest.save_registry(old, path)
    number, first = manifest.saved_registry(spark, path)
    manifest.save_registry(manifest.saved_registry(spark, path)[1].unionAll(old), path)  # reads what it follows
    assert (number, first.count()) == (1, 1)
    number, second = manifest.saved_registry(spark, path)
    assert (number, second.count()) == (2, new.count())
    new.write.parquet(f"{path}/gen-000000003")  # cut off before its marker
    assert manifest.saved_registry(spark, path)[0] == 2


def test_msetnx_counts_what_earlier_requests_made(spark):
    import random

    rng = random.Random(3)
    pairs = [(r, p, f"k{rng.randrange(60)}", f"v{r}") for r in range(80) for p in range(rng.randint(1, 3))]
    held = {"k1", "k2"}
    want = set()
    for r in range(80):
        keys = {k for q, _, k, _ in pairs if q == r}
        if not keys & held:
            held |= keys
            want.add(r)
    df = spark.createDataFrame(pairs, "request long, pos int, key string, value string")
    out = strings.msetnx(df, spark.createDataFrame([("k1",), ("k2",)], "key string")).collect()
    assert {r.request for r in out} == want
    assert sorted((r.request, r.pos) for r in out) == sorted((q, p) for q, p, _, _ in pairs if q in want)
    assert strings.msetnx(df.limit(0), df.select("key")).count() == 0


def test_time_to_live_of_each_command(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, at, "psetex", "a", "x", 500), (2, at, "setex", "b", "x", 5), (3, at, "setex", "c", "x", 5), (4, at, "del", "c", None, None)], "seq long, ts timestamp, cmd string, key string, value string, ttl long")
    ends = {r.key: r.expire_at for r in strings.ttl_live(log, F.lit(at)).collect()}
    assert ends == {"a": at + dt.timedelta(milliseconds=500), "b": at + dt.timedelta(seconds=5)}
    assert {r.seq: r.expire_at for r in strings.getex(log).collect()}[4] is None


def test_spool_refuses_nulls(spark, tmp_path):
    spool.register(spark)
    rows = spark.createDataFrame([(bytearray(b"k"), None)], "key binary, value binary")
    with pytest.raises(Exception, match="null can't be written"):
        rows.write.format("kvspool").mode("append").save(f"file://{tmp_path}/spool")
