"""Choose values for training: a Bernoulli gate, a bounded uniform sample, a capped spool."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.functions.incompressible import is_incompressible, looks_random
from lexikv.operators.routing import DEFAULT


def draw(key: Column) -> Column:
    """A fixed 32-bit draw for a key, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def bernoulli(key: Column, p: float) -> Column:
    """Whether the key is in a sample of share ``p``."""
    return draw(key) <= math.floor(p * 4294967295)


def running_sum(df: DataFrame, size: Column, seq: str, out: str, chunk: int = 65_536) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows up to each, in order of ``seq`` (unique, non-negative).

    Ranges of the sequence are summed alone; only the totals of ranges are put
    in one order.
    """
    parts = df.withColumn("_chunk", F.floor(F.col(seq) / chunk)).withColumn("_size", size)
    totals = parts.groupBy("_chunk").agg(F.sum("_size").alias("_total"))
    before = totals.select("_chunk", F.coalesce(F.sum("_total").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_size").over(Window.partitionBy("_chunk").orderBy(seq))
    return parts.withColumn("_within", within).join(before, "_chunk").withColumn(out, F.col("_before") + F.col("_within")).drop("_chunk", "_size", "_within", "_before")


def warm_up(df: DataFrame, max_bytes: int, length: str = "len", seq: str = "seq") -> DataFrame:
    """One row (k, bytes): the items before the first that doesn't fit, and their size.

    Items longer than ``max_bytes`` are passed over; there are slots for
    ``max_bytes`` / 100 items.
    """
    fit = running_sum(df.filter(F.col(length) <= max_bytes), F.col(length), seq, "_sum")
    first_bad = fit.filter(F.col("_sum") > max_bytes).agg(F.min(seq).alias("_bad"))
    kept = fit.join(F.broadcast(first_bad), F.col("_bad").isNull() | (F.col(seq) < F.col("_bad")))
    slots = max_bytes // 100
    kept = kept.orderBy(seq).limit(slots)
    return kept.agg(F.count("*").alias("k"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"))


def reservoir(df: DataFrame, k: int, seed: int = 0, seq: str = "seq") -> DataFrame:
    """``k`` rows chosen uniformly: those of least keyed hash of ``seq``; samples of parts merge the same way."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(seq).cast("string")).cast("binary"))
    return df.withColumn("_order", order).orderBy("_order", seq).limit(k).drop("_order")


def _in_window(df: DataFrame, ts: str | None, seconds: int) -> DataFrame:
    """Rows of the first ``seconds`` after the least time; all without a time column or with 0."""
    if ts is None or not seconds:
        return df
    start = df.agg(F.min(ts).alias("_start"))
    return df.join(F.broadcast(start), F.col(ts) < F.col("_start") + F.make_dt_interval(secs=F.lit(seconds)), "left_semi")


def training_feed(df: DataFrame, config: Config, key: str = "key", value: str = "value", ns: str = "ns", ts: str | None = None, magic: bool = True) -> DataFrame:
    """Values fit for training: right size, in the sample, not packed already, of the default namespace.

    With a time column ``ts``, those of the session's window (``training_window_duration``), which the first row opens.
    Without ``magic``, values that begin like packed ones are judged by their content alone.
    """
    df = _in_window(df, ts, config.training_window_duration)
    right_size = F.octet_length(value).between(config.min_size, config.max_comp_size)
    return df.filter(right_size & F.lit(config.enable_training)).filter(bernoulli(F.col(key), config.sample_p)).filter(F.col(ns) == DEFAULT).filter(~(is_incompressible if magic else looks_random)(F.col(value)))


def spool_records(df: DataFrame, config: Config, key: str = "key", value: str = "value", seq: str = "seq", ts: str | None = None) -> DataFrame:
    """Sampled (seq, key, value) until the cap; the record that crosses it is the last.

    With a time column ``ts``, until ``sample_window_duration`` has passed since the first row.
    """
    df = _in_window(df, ts, config.sample_window_duration)
    cap = config.spool_max_bytes or 64 * 1024 * 1024
    rows = df.filter(F.lit(config.enable_sampling) & bernoulli(F.col(key), config.sample_p)).select(F.col(seq).alias("seq"), F.col(key).cast("binary").alias("key"), F.col(value).cast("binary").alias("value"))
    size = F.lit(8) + F.octet_length("key") + F.octet_length("value")
    return running_sum(rows, size, "seq", "_sum").filter(F.col("_sum") - size < cap).drop("_sum")
