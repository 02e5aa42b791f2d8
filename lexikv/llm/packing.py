"""Pack tokenised documents into fixed windows by best-fit decreasing.

Every document is first cut into full windows; only what remains of it, less
than a window, is placed.  Remainders go largest first into the open window
with the least room that suffices, which a segment tree over remaining
capacities finds in log(window) steps.  Pieces are numbered, written out and
dealt into blocks by a hash of their number, each packed by one task, so a
task's memory is bounded whatever ids repeat, and only the last few windows of
a block stay part empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikv.llm.tokens import TokenIds
from lexikv.llm.words import give_back, slices
from lexikv.workspace import settle, small_batches


class CapacityTree:
    """Open windows by remaining capacity; the tightest that fits is found in O(log capacity).

    A binary tree over the capacities 0..size-1 counts the open windows below
    each node.
    """

    def __init__(self, largest: int) -> None:
        self.size = 1 << max(1, (largest + 1).bit_length())
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of least capacity >= need."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at ^ 1]):  # up to where a right sibling has windows
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        window = self.open[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths are 1..window."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity, bins[i] = tree.take(need) or (window, opened)
        opened = max(opened, int(bins[i]) + 1)
        offsets[i] = window - capacity
        if capacity > need:
            tree.add(capacity - need, int(bins[i]))
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, window: int, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's tokens and ``end_id``, cut after every ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens; the ids themselves
    can be made again from the text.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end, step = np.array([end_id], "<u4").tobytes(), 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenIds.of(tokenizer)
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, a // 4, min(window, n - a // 4), zlib.crc32(ids[a : a + step]), n) for a in range(0, len(ids), step)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], columns)
        encoder.rest()
        give_back()

    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, ", ".join(f"{c} long" for c in columns))


def pack(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, block_pieces: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are unique, not dense: the block of pieces and the window in
    it.  A null or empty text is its end id alone.  Documents that repeat an
    id are packed separately.  A very long text is encoded in parts and gives
    as many full windows as it fills.  An empty table gives no rows; other
    columns are ignored.
    """
    small_batches(df.sparkSession)
    cut = settle(pieces(df, tokenizer, window, end_id, id, text).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, math.ceil(cut.count() / block_pieces))
    cut = cut.withColumn("_block", F.pmod(F.xxhash64("_piece"), F.lit(blocks)).cast("int")).drop("_piece")

    def place(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        length = block["length"].to_numpy()
        full = length == window
        bins, offsets = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        bins[full] = np.arange(full.sum())
        bins[~full], offsets[~full] = best_fit_decreasing(length[~full], window)
        bins[~full] += full.sum()
        return block.drop(columns="_block").assign(sequence_id=(int(key[0]) << 40) + bins, offset=offsets)

    return cut.groupBy("_block").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
