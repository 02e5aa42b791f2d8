"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikv.llm import decontaminate, near_dup, packing, toxicity
from lexikv.llm import queries as q
from lexikv.workspace import passing, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of ``docs`` and keep what isn't predicted toxic, with the columns it had."""
    model = toxicity.train(docs, q.table(spark, sf_dir, "labels"), F.lit(False))
    judged = toxicity.score(docs.select("text", F.struct("*").alias("_row")), model)
    return judged.filter("predicted = 0").select("_row.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number for each row that no later read changes."""
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


_MAP_ROWS = 1 << 20  # of two numbers each, at most about 32 MB to broadcast


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose ``_row`` is in ``gone``.

    ``gone`` becomes a bit map with a line for each 64 row numbers, which goes
    to the rows, so that their texts aren't shuffled.  A map too long for that,
    of over 64 million rows, meets them in a shuffle.
    """
    word, place = F.shiftright("_row", 6).alias("_word"), F.col("_row").bitwiseAND(F.lit(63)).cast("int").alias("_place")
    held = settle(gone.select(word, place).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_bits")), "gone")
    small = held.count() <= _MAP_ROWS
    marked = rows.select("*", word, place).join(F.broadcast(held) if small else held, "_word", "left")
    return marked.filter(F.coalesce(F.bit_get("_bits", "_place"), F.lit(0)) == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that of least id, rows without an id last.

    Each row is compared, also those that repeat an id.
    """
    rows = _numbered(docs)
    with passing(spark):  # its tables go before the rows are written
        copies = settle(_copies(rows), "copies")
    return _without(rows, copies).select(docs.columns)


def _copies(rows: DataFrame) -> DataFrame:
    """The numbers of the rows to drop."""
    found = near_dup.near_duplicates(rows, id="_row")
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"), "kept")
    groups = settle(found.join(rows.select("_row", F.col("doc_id").cast("long").alias("_id")), "_row"), "groups")
    # a group bears the number of its least row, which is the one kept unless another has the least id
    least = groups.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("_least"))
    moved = settle(least.select("_group", "_least._row").filter("_row <> _group"), "moved")
    return groups.filter("not kept").select("_row").join(moved, "_row", "left_anti").unionAll(moved.select("_group"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep rows without a passage of the benchmark; each row is judged by its own text."""
    rows = _numbered(docs)
    with passing(spark):  # the index goes before the rows are written
        hit = decontaminate.contamination(rows, q.table(spark, sf_dir, "benchmark"), id="_row").filter("contaminated")
        hit = settle(hit.select(F.col("doc_id").alias("_row")), "hit")
    return _without(rows, hit).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written out before the next reads it, and its own tables are deleted."""
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
