"""Texts that a decision doesn't touch stay where they are."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexikv.llm import near_dup, queries
from tests.llm.conftest import SF


def test_without_rows_sends_a_map_to_the_rows(spark):
    rows = spark.range(0, 1000, numPartitions=7).select(F.monotonically_increasing_id().alias("_row"), F.col("id").cast("string").alias("text"))
    rows = corpus_pipeline.settle(rows, "rows")
    numbers = sorted(r._row for r in rows.select("_row").collect())
    gone = numbers[::3] + numbers[-2:]
    out = corpus_pipeline._without(rows, spark.createDataFrame([(x,) for x in gone], "_row long"))
    assert sorted(r._row for r in out.collect()) == sorted(set(numbers) - set(gone))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_dropped_by_a_long_map(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "_MAP_ROWS", 0)
    rows = spark.range(500).withColumnRenamed("id", "_row")
    out = corpus_pipeline._without(rows, spark.range(0, 500, 2).withColumnRenamed("id", "_row"))
    assert [r._row for r in out.orderBy("_row").collect()] == list(range(1, 500, 2))


def test_only_wanted_texts_are_joined(spark):
    docs = queries.table(spark, SF, "documents").select(F.col("doc_id").alias("doc"), "text")
    wanted = docs.filter("doc % 40 = 0").select("doc", (F.col("doc") * 10).alias("id"))
    near = near_dup._texts(docs, wanted)
    assert {(r.doc, r.id) for r in near.collect()} == {(r.doc, r.id) for r in wanted.collect()}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "_bits" in plan  # a map of the wanted ones filters the texts before the join


def test_clusters_are_bounded_by_their_work(spark):
    s = near_dup.Settings()
    docs, shingles = 4800, 4800 * 395  # the largest cluster of check_l at twelve times its size
    assert docs <= s.cluster_docs and shingles <= s.cluster_shingles and docs * shingles <= s.cluster_work
    rows = queries.table(spark, SF, "documents")
    out = [near_dup.near_duplicates(rows, near_dup.Settings(cluster_work=w)).select("doc_id", "component_id").collect() for w in (1, s.cluster_work)]
    assert sorted(out[0]) == sorted(out[1])
