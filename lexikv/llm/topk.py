"""Exact nearest vectors by inner product, as a grid of matrix tiles.

Queries are dealt into row blocks and vectors into column blocks; a task
multiplies one block of each and keeps every query's best few of that tile.
The partial lists then meet in a tree of bounded fan-in.  A tile holds at most
about ``tile_queries`` x ``tile_vectors`` scores, so memory is bounded at any
size, and nothing is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexikv.workspace import settle

_FAN_IN = 64
_STEP = 2048


def _usable(vector: str) -> F.Column:
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def quantised(rows: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of each component x, taken as double."""
    return np.floor(scale * np.array(rows.tolist(), np.float64).reshape(len(rows), -1))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; Python integers where a double would round."""
    top = (np.abs(q).max(initial=0) or 1) * (np.abs(v).max(initial=0) or 1) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ v.T).astype(np.int64)
    as_int = np.vectorize(int, otypes=[object])
    exact = as_int(q).dot(as_int(v).T) if q.size and v.size else np.zeros((len(q), len(v)), object)
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, x)), otypes=[np.int64])(exact)


def _first(row: np.ndarray, score: np.ndarray, position: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each row with the highest score, ties by the smaller position."""
    order = np.lexsort((position, ~score, row))
    row, score, position = row[order], score[order], position[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], score[rank < k], position[rank < k]


def _tile(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(vectors):
        q, q_id = quantised(queries["_v"], scale), queries["_id"].to_numpy()
        vectors = vectors.sort_values("_id", kind="stable")
        v, v_id = quantised(vectors["_v"], scale), vectors["_id"].to_numpy()
        q_row, v_row = queries["_row"].to_numpy(), vectors["_row"].to_numpy()
        for a in range(0, len(q), 256):
            # row, score and position of the best of each row so far
            best = [np.empty(0, np.int64)] * 3
            for b in range(0, len(v), _STEP):
                s = _scores(q[a : a + 256], v[b : b + _STEP])
                own = q_row[a : a + 256, None] == v_row[None, b : b + _STEP]
                s = np.where(own, np.iinfo(np.int64).min, s)
                # all that reach the k-th best score of the part; ties are settled by position, which is by id
                least = s.min(axis=1) if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                i, j = np.nonzero((s >= least[:, None]) & ~own)
                best = _first(*(np.concatenate(x) for x in zip(best, (i, s[i, j], j + b), strict=True)), k)
            i, score, j = best
            out.append(pd.DataFrame({"query_id": q_id[a + i], "vec_id": v_id[j], "score": score, "_query": q_row[a + i]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score", "_query")})


def top_k(df: DataFrame, is_query: F.Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, tile_queries: int = 2048, tile_vectors: int = 16384) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    Null vectors and vectors with a null or non-finite component take no part,
    nor do rows with a null id.  A row is no candidate for itself, but rows
    that repeat its id and vector are for each other.  Vectors of different
    lengths aren't compared; a very long vector counts like any other.  Scores
    beyond a long are cut to its ends.  A column of texts isn't looked at.
    Other columns are ignored.
    """
    # written out, so that a row keeps its number wherever it is read
    rows = df.select(F.col(id).cast("long").alias("_id"), F.col(vector).alias("_v"), is_query.alias("_is_query"), F.size(vector).alias("_dim"), F.monotonically_increasing_id().alias("_row")).filter(F.col("_id").isNotNull() & _usable("_v"))
    rows = settle(rows, "vectors")
    n_vectors, n_queries = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("_is_query").cast("long")), F.lit(0))).first()
    across, down = max(1, math.ceil(n_vectors / tile_vectors)), max(1, math.ceil(n_queries / tile_queries))
    # neither side may have too few blocks to share the work, nor tiles that are too small to pay
    across = max(across, min(64, n_vectors // 1024))
    deal = lambda n, seed: F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n)).cast("int")
    queries = rows.filter("_is_query").withColumn("_down", deal(down, 1)).withColumn("_across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    vectors = rows.withColumn("_across", deal(across, 2)).withColumn("_down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cell = ["_dim", "_across", "_down"]

    def multiply(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _tile(q, v.set_axis(q.columns, axis=1), k, scale).assign(_part=int(key[1]))[["query_id", "vec_id", "score", "_query", "_part"]]

    columns = ["_id", "_v", "_row", *cell]
    # the sides come from the same rows and need names of their own
    right = vectors.select(*(F.col(c).alias(f"{c}_r") for c in columns)).groupBy(*(f"{c}_r" for c in cell))
    best = queries.select(*columns).groupBy(*cell).cogroup(right).applyInPandas(multiply, "query_id long, vec_id long, score long, _query long, _part int")
    merged_by = Window.partitionBy("_query", "_part").orderBy(F.desc("score"), "vec_id")
    while True:
        across = math.ceil(across / _FAN_IN)
        best = best.withColumn("_part", (F.col("_part") / _FAN_IN).cast("int")).withColumn("rank", F.row_number().over(merged_by)).filter(F.col("rank") <= k)
        if across == 1:
            return best.select("query_id", "rank", "vec_id", "score")
