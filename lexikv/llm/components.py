"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikv.workspace import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); a component is its least node.

    Alternates two star contractions: every node's larger neighbours, then its
    smaller ones, are hung on the least neighbour.  The edges end as stars
    around the least nodes, after about log(diameter) rounds.  Links to itself
    and repeated links do no harm; null ends are passed over.  Each round is
    written out, so a lost executor costs one round at most.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        hung = large.join(least, "u")
        small = hung.filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(least.select("u", F.col("least").alias("v")))
        edges = settle(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
