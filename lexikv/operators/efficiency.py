"""Follow how well values compress, and decide when to train anew.

The moving average is e1 = s1, ei = a * si + (1 - a) * e(i-1), so a run of n
ratios turns e into (1 - a)**n * e + (a weighted sum).  Such steps compose, so
the log is cut into ranges of the sequence, each folded alone, and only the
folds of the ranges are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folded(rows: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """Rows (n, sum, first) of each group, ordered by _seq; sum weighs each ratio by alpha * (1 - alpha)**(later ones)."""
    w = Window.partitionBy(*by)
    later = F.count("*").over(w) - F.row_number().over(w.orderBy("_seq"))
    weighed = rows.withColumn("_later", later)
    return weighed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_s") * alpha * F.pow(F.lit(1 - alpha), F.col("_later"))).alias("total"), F.min_by("_s", "_seq").alias("first"), F.sum("_raw").alias("bytes"), F.min("_seq").alias("from"))


def track(df: DataFrame, alpha: float, seq: str = "seq", raw: str = "raw", compressed: str = "cmp", group: str | None = None, chunk: int = 65_536) -> DataFrame:
    """(group, observations, ewma, baseline, bytes): the tracker's state after all rows.

    The first ratio seeds average and baseline.  Rows without a positive raw
    size are passed over.  ``chunk`` sequence numbers are folded at a time;
    gaps in the sequence don't matter.  An empty table gives no rows.
    """
    name = F.col(group) if group else F.lit(0)
    rows = df.select(name.alias("_g"), F.col(seq).alias("_seq"), (F.col(compressed) / F.col(raw)).cast("double").alias("_s"), F.col(raw).cast("long").alias("_raw")).filter("_raw > 0 and _s is not null and _seq is not null")
    parts = _folded(rows.withColumn("_chunk", F.floor(F.col("_seq") / chunk)), alpha, ["_g", "_chunk"])
    # few rows from here: one for each chunk
    w = Window.partitionBy("_g")
    after = F.sum("n").over(w) - F.sum("n").over(w.orderBy("_chunk"))
    parts = parts.withColumn("_after", after)
    keep = F.pow(F.lit(1 - alpha), F.col("_after"))
    out = parts.groupBy("_g").agg(F.sum("n").alias("observations"), F.sum(F.col("total") * keep).alias("t"), F.min_by("first", "_chunk").alias("baseline"), F.sum("bytes").alias("bytes"))
    # the first ratio counts in full, not with weight alpha
    ewma = F.col("t") + F.col("baseline") * (1 - alpha) * F.pow(F.lit(1 - alpha), F.col("observations") - 1)
    return out.select(*([F.col("_g").alias(group)] if group else []), "observations", ewma.alias("ewma"), "baseline", "bytes")


def should_retrain(ewma: Column, baseline: Column, bytes_since: Column, seconds_since: Column, interval: int, min_bytes: int, drop: float, enabled: bool = True) -> Column:
    """Enough time and bytes have passed, and the average has moved by ``drop`` of the baseline, either way."""
    moved = baseline.isNull() | (baseline == 0) | (F.abs(ewma / baseline - 1) >= drop)
    return F.lit(enabled) & (seconds_since >= interval) & (bytes_since >= min_bytes) & F.coalesce(moved, F.lit(True))


def trigger(ewma: Column, baseline: Column) -> Column:
    """rise: compression has become better; drop: worse."""
    return F.when(ewma < baseline, "rise").when(ewma > baseline, "drop")


def after_training(ewma: Column, baseline: Column) -> Column:
    """The baseline once a new dictionary is in use."""
    return F.least(baseline, ewma)
