"""Key-value views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = ["doc:", "doc:en:", "page:", "conv:"]
COMMANDS = {"signup": "setnx", "purchase": "set", "click": "append", "view": "get", "error": "getdel"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, value)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc:"), "lang", F.lit(":"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("value"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).unionAll(pages(spark, sf_dir))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, field, value): turns of conversations."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("key"), F.col("turn").cast("string").alias("field"), F.col("text").alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, cmd, key, value, ttl): events as commands on users."""
    cmd = F.element_at(F.create_map(*(F.lit(x) for pair in COMMANDS.items() for x in pair)), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.coalesce(cmd, F.lit("get")).alias("cmd"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), (F.col("event_id") % 7 * 86400).alias("ttl"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry made of orders: created at the order's date for its priority, some also for ``default``."""
    o = table(spark, sf_dir, "orders")
    names = F.when(F.col("o_custkey") % 5 == 0, F.array("o_orderpriority", F.lit("default"))).otherwise(F.array("o_orderpriority"))
    return o.select(
        (F.col("o_orderkey") % 65535 + 1).cast("int").alias("id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("uuid"), F.lit(None).cast("binary").alias("dict"), names.alias("namespaces"),
        F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 30 days")).alias("retired"), F.lit(3).alias("level"), F.lit(None).cast("string").alias("signature"),
        F.floor("o_totalprice").cast("long").alias("dict_size"),
    )


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, raw, cmp): sizes made of event values."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", (F.lit(1000) + F.col("event_id") % 13).alias("raw"), F.floor(F.abs("value") % 1000).cast("long").alias("cmp"))
