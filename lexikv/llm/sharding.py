"""Deal rows into shards whose mixture of sources matches the whole.

Rows of each source are shuffled by a seeded hash and get a fractional rank,
(position + phase) / rows of the source, with a phase in 0..1 for each source,
so that sources of a single row don't meet in the middle.  All rows sorted by
that fraction interleave the sources in proportion, and equal cuts of that
order are the shards.

Both rankings are exact without gathering a source in one task: rows fall into
value buckets, the counts of the buckets are summed up, and only the order
within a bucket of bounded size is found by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikv.workspace import settle

_BUCKET_ROWS = 4096
_BROADCAST_ROWS = 100_000  # of (source, count); a longer list is joined by a shuffle


def _ranked(df: DataFrame, group: list[str], share: Column, order: list[str], buckets: Column | int, out: str) -> DataFrame:
    """Add the 0-based rank of each row in its group, by ``share`` (0 <= share < 1) and then ``order``."""
    df = df.withColumn("_bucket", F.least(F.floor(share * buckets), F.lit(buckets) - 1).cast("long") if isinstance(buckets, int) else F.floor(share * buckets).cast("long"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order))
    keys = [*group, "_bucket"]
    numbered = df.withColumn("_within", within).alias("l").join(sizes.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys])
    return numbered.select("l.*", (F.col("r._before") + F.col("l._within") - 1).alias(out)).drop("_bucket", "_within")


def shuffle_key(id: Column, seed: int) -> Column:
    """32 hexadecimal digits that order rows at random; the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))


def _unit(key: Column) -> Column:
    """A key's first 32 bits as a number in 0..1, below 1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def interleave(df: DataFrame, n_shards: int, stratum: str = "source", id: str = "doc_id", seed: int = 7) -> DataFrame:
    """``df`` with columns shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Row counts of shards differ by one at most.  A null stratum is a stratum
    of its own.  Rows that repeat an id follow each other in the shuffle in an
    order that all their columns decide; equal rows are interchangeable.
    Texts of any length, null ones too, are rows like others.  An empty table
    gives no rows.  Columns of ``df`` named shard or slot are
    replaced.
    """
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*keep).alias("_row"), F.col(stratum).cast("string").alias("_stratum"), F.col(id).cast("string").alias("_id")).withColumn("_tie", F.xxhash64("_row"))
    # rows without an id are shuffled by all their columns
    key = F.when(F.col("_id").isNotNull(), shuffle_key(F.col("_id"), seed)).otherwise(shuffle_key(F.concat(F.lit("?"), F.col("_tie").cast("string")), seed))
    # settled, as several jobs read it and equal keys must keep their order
    rows = settle(rows.withColumn("_key", key), "strata")
    sizes = settle(rows.groupBy("_stratum").agg(F.count("*").alias("_size")), "sizes")
    strata, total = sizes.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    sizes = F.broadcast(sizes) if strata <= _BROADCAST_ROWS else sizes
    rows = rows.alias("l").join(sizes.alias("r"), F.col("l._stratum").eqNullSafe(F.col("r._stratum"))).select("l.*", "r._size")
    share = _unit(F.col("_key"))
    # at least 64 buckets for a large source, so that it spreads over tasks of any size
    per_source = F.greatest(F.ceil(F.col("_size") / _BUCKET_ROWS), F.least(F.lit(64), F.ceil(F.col("_size") / 64)))
    order = ["_key", "_id", "_tie"]
    ranked = _ranked(rows, ["_stratum"], share, order, per_source, "_rank")
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + _unit(shuffle_key(F.col("_stratum"), seed))) / F.col("_size"))
    placed = _ranked(ranked.withColumn("_all", F.lit(0)), ["_all"], F.col("_fraction"), ["_fraction", "_stratum", *order], max(64, -(-total // _BUCKET_ROWS)), "_position")
    small, extra = divmod(total, n_shards)
    in_large = F.col("_position") < extra * (small + 1)
    rest = F.col("_position") - extra * (small + 1)
    return placed.select(
        "_row.*",
        F.when(in_large, F.floor(F.col("_position") / (small + 1))).otherwise(extra + F.floor(rest / max(1, small))).cast("int").alias("shard"),
        F.when(in_large, F.pmod(F.col("_position"), F.lit(small + 1))).otherwise(F.pmod(rest, F.lit(max(1, small)))).cast("long").alias("slot"),
    )
