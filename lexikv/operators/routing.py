"""Send a key to the namespace of its longest matching prefix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "default"
_CASE_LIMIT = 256


def route(key: Column, prefixes: Iterable[str]) -> Column:
    """The longest of a few prefixes that ``key`` starts with, else ``default``; null for null."""
    out = F.lit(None).cast("string")
    for prefix in sorted({p for p in prefixes if p and p != DEFAULT}, key=lambda p: (len(p), p)):
        out = F.when(F.startswith(key, F.lit(prefix)), F.lit(prefix)).otherwise(out)
    return F.when(key.isNotNull(), F.coalesce(out, F.lit(DEFAULT)))


def route_by(df: DataFrame, namespaces: DataFrame, key: str = "key", prefix: str = "ns") -> DataFrame:
    """``df`` with a column ns, by a table of prefixes.

    A short table becomes a chain of comparisons.  With a longer one each
    distinct key, found with a map-side combine, is joined by equality on
    (length, prefix of the key of that length), one probe for each length that
    occurs, and then named in ``df``.  Null and empty prefixes are passed over.
    """
    known = namespaces.select(F.col(prefix).alias("ns")).filter((F.col("ns") != "") & (F.col("ns") != DEFAULT)).distinct()
    few = [r[0] for r in known.limit(_CASE_LIMIT + 1).collect()]
    rest = [c for c in df.columns if c != "ns"]
    if len(few) <= _CASE_LIMIT:
        return df.select(*rest, route(F.col(key), few).alias("ns"))
    sizes = known.agg(F.collect_set(F.length("ns")).alias("lengths"))  # one row, as many numbers as prefixes have lengths
    keys = df.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    probes = keys.join(F.broadcast(sizes)).select("_key", F.explode("lengths").alias("n")).filter(F.length("_key") >= F.col("n")).select("_key", "n", F.substring(F.col("_key"), F.lit(1), F.col("n")).alias("ns"))
    best = probes.join(known, "ns").groupBy("_key").agg(F.max_by("ns", "n").alias("ns"))
    return df.select(*rest).join(best, F.col(key) == F.col("_key"), "left").select(*rest, F.when(F.col(key).isNotNull(), F.coalesce("ns", F.lit(DEFAULT))).alias("ns"))
