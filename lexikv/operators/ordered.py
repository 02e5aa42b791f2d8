"""Values carried along an ordered history, without gathering a key's history in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, key: str, seq: str, change: Column, out: str, inclusive: bool = False, chunk: int = 65_536) -> DataFrame:
    """``df`` with ``out``: the last non-null ``change`` of the key before each row (or up to it), in order of ``seq``.

    ``seq`` is a non-negative integer, unique in each key.  A window sees
    ``chunk`` sequence numbers of a key at most; what earlier chunks leave is
    carried over by a table of one row for each key and chunk, so a key may
    hold any share of all rows.
    """
    parts = df.withColumn("_chunk", F.floor(F.col(seq) / chunk)).withColumn("_change", change)
    within = Window.partitionBy(key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = parts.groupBy(key, "_chunk").agg(F.max_by("_change", F.when(F.col("_change").isNotNull(), F.col(seq))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    here = parts.withColumn("_within", F.last("_change", ignorenulls=True).over(within))
    joined = here.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce("_within", "_carried").alias(out))
