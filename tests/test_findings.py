"""What the review of the second round found."""

import datetime

import duckdb
import pytest

from lexikv.operators import registry
from lexikv.operators.codec import Codec
from lexikv.plans.oracles import SQL
from lexikv.plans.queries import QUERIES


def _registry(spark, rows):
    """Registry rows from (id, uuid, day)."""
    made = [(i, u, None, ["default"], datetime.datetime(2024, 1, d), None, 3, None, 1) for i, u, d in rows]
    return spark.createDataFrame(made, registry.SCHEMA)


def test_new_dictionaries_beyond_the_free_ids_wait(spark, monkeypatch):
    monkeypatch.setattr(registry, "MAX_ID", 5)
    held = _registry(spark, [(2, "a", 1), (4, "b", 1), (900_000, "c", 1)])
    added = _registry(spark, [(None, f"n{d}", d) for d in (9, 3, 7, 5, 8)])
    out = registry.publish(held, added, waiting=True)
    assert {r.uuid: r.id for r in out.collect()} == {"a": 2, "b": 4, "c": 900_000, "n3": 1, "n5": 3, "n7": 5, "n8": None, "n9": None}
    assert out.count() == 8
    with pytest.raises(ValueError, match="want an id"):
        registry.publish(held, added)


def test_ranks_do_not_depend_on_the_order_of_rows(spark):
    rows = [(7, u, 1) for u in "bdac"]
    ranks = [{r.uuid: r.rank for r in registry.ranked(_registry(spark, x).coalesce(1)).collect()} for x in (rows, rows[::-1])]
    assert ranks == [{"d": 1, "c": 2, "b": 3, "a": 4}] * 2


@pytest.fixture(scope="module")
def magic_texts(spark, tmp_path_factory):
    """A folder with documents that begin like compressed files but are plain text."""
    folder = str(tmp_path_factory.mktemp("magic"))
    starts = ["BZh", "ID3", "(S", "Hj", "GIF89a", "%PDF-", "plain"]
    rows = [(i, starts[i % len(starts)] + " and more words of text" * 4, "de") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def _equals_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(f"select * from ({SQL[name]})")
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(want.columns).collect())) == sorted(want.fetchall())


def test_rule_by_content_equals_sql_on_texts_with_magic(spark, magic_texts):
    _equals_sql(spark, "incompressible_rule", magic_texts)


def test_training_feed_equals_sql_on_texts_with_magic(spark, magic_texts):
    _equals_sql(spark, "training_feed", magic_texts)


def test_codec_bounds_the_batches_that_python_holds(spark):
    kept = {k: spark.conf.get(k) for k in (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))}
    for k, v in zip(kept, ("10000", "268435456"), strict=True):
        spark.conf.set(k, v)
    Codec(spark)
    assert [int(spark.conf.get(k).rstrip("bB")) for k in kept] == [1000, 2 << 20]
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["ns_snapshot", "stats_entries"])
def test_snapshots_read_and_write_in_bounded_batches(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "10000")
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert int(spark.conf.get(key)) == 1000
    spark.conf.set(key, kept)
