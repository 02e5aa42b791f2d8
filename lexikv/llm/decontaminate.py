"""Find benchmark passages in a corpus with a distributed positional inverted index.

The index is split by document into segments.  A segment stores the postings of
all its terms: the positions of each in the segment's words.  It is built and
written once and serves any benchmark.  A window of benchmark words is searched
from its rarest term in the whole corpus: each posting of that term gives a
start, and the postings of the other terms, less their offsets, are intersected
with the starts, the rarer ones first.  A segment looks at those windows alone
of which it has every term, all at once.  What is left are the starts of exact
phrases; with a ``slop``, lists meet within that many words, which gives
proximity matches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikv.llm import words as W
from lexikv.workspace import settle, small_batches

_SEGMENT_BYTES = 4 << 20
#: Benchmark text searched at once, which bounds what is broadcast (at most 17 bytes for each byte of text, mostly 4).
_PASS_BYTES = 2 << 20
_PAIRS = 1 << 20  # starts that are intersected at once


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments: segment (number), docs (ids), counts (words of each), terms, sizes and positions of their postings.

    ``terms`` are the distinct word hashes, ascending, as differences;
    ``positions`` are word numbers in the segment, ascending in each term.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in W.slices(batches, "text", _SEGMENT_BYTES):
            w = W.scan(batch.column("text"), W.ALNUM)
            order = np.argsort(w.hash, kind="stable")
            terms, first = np.unique(w.hash[order], return_index=True)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([number], pa.int64()), "docs": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), "counts": pa.array([w.counts.astype("<u4").tobytes()]),
                "terms": pa.array([W.planes(np.diff(terms, prepend=np.uint64(0)))]), "sizes": pa.array([W.planes(np.diff(first, append=len(order)).astype("<u4"))]),
                "positions": pa.array([W.planes(order.astype("<u4"))]),
            })
            number += 1

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return settle(rows.mapInArrow(segments, "segment long, docs array<long>, counts binary, terms binary, sizes binary, positions binary"), "postings")


def _terms(column: pa.Array, i: int) -> np.ndarray:
    return np.cumsum(W.from_planes(column[i].as_buffer(), "<u8"), dtype=np.uint64)


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each term of the sorted ``vocabulary`` in the whole corpus."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held.value
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, own, at = np.intersect1d(_terms(batch.column("terms"), i), vocab, assume_unique=True, return_indices=True)
                total[at] += W.from_planes(batch.column("sizes")[i].as_buffer(), "<u4")[own]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    found = index.select("terms", "sizes").mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row for each benchmark term at most
    out = np.zeros(len(vocabulary), np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Plan(NamedTuple):
    """Windows of words in order of their rarest term, as flat arrays."""

    items: list[str]  #: sorted
    vocabulary: np.ndarray  #: sorted word hashes
    terms: np.ndarray  #: numbers in the vocabulary of all items' words, one item after the other
    begin: np.ndarray  #: of each window in ``terms``
    length: np.ndarray
    item: np.ndarray  #: of each window, a number in ``items``
    order: np.ndarray  #: (window, place): offsets of its words, that of the rarest first
    cuts: np.ndarray  #: windows cuts[t] to cuts[t + 1] have t as their rarest term

    @classmethod
    def of(cls, texts: list[tuple[object, str | None]], n: int, counts_of) -> Plan:
        """Runs of ``n`` words; an item of fewer words, but not none, is one window.  Windows with a term that the corpus lacks are left out."""
        items = sorted({str(item) for item, _ in texts})
        number = {item: i for i, item in enumerate(items)}
        w = W.scan(pa.array([text for _, text in texts], pa.string()), W.ALNUM)
        vocabulary, terms = np.unique(w.hash, return_inverse=True)
        counts = np.append(counts_of(vocabulary), np.iinfo(np.int64).max)
        first = np.cumsum(w.counts) - w.counts
        windows = np.where(w.counts > 0, np.maximum(1, w.counts - n + 1), 0)
        row = np.repeat(np.arange(len(texts)), windows)
        begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[row]
        length = np.minimum(n, w.counts[row])
        place = np.arange(n)
        held = np.where(place < length[:, None], np.append(terms, 0)[np.minimum(begin[:, None] + place, len(terms))], len(vocabulary))
        order = np.argsort(counts[held], axis=1, kind="stable")
        rarest = held[np.arange(len(held)), order[:, 0]] if len(held) else np.empty(0, np.int64)
        keep = np.flatnonzero(counts[rarest] > 0)
        keep = keep[np.argsort(rarest[keep], kind="stable")]
        item = np.array([number[str(i)] for i, _ in texts], np.int32)[row] if texts else np.empty(0, np.int32)
        return cls(
            items, vocabulary, terms.astype(np.int32), begin[keep].astype(np.int32), length[keep].astype(np.min_scalar_type(n)), item[keep],
            order[keep].astype(np.min_scalar_type(n)), np.searchsorted(rarest[keep], np.arange(len(vocabulary) + 1)).astype(np.int32),
        )


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high - 1, and the range of each."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


def _matches(plan: Plan, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of all matches in a segment's postings; starts may lie across documents."""
    _, own, known = np.intersect1d(terms, plan.vocabulary, assume_unique=True, return_indices=True)
    ends = np.cumsum(sizes.astype(np.int64))
    at, of = _spread(ends[own] - sizes[own], ends[own])
    keys = (known[of].astype(np.int64) << 32) | positions[at]  # ascending
    present = np.zeros(len(plan.vocabulary), bool)
    present[known] = True
    low, high = np.zeros(len(present), np.int64), np.zeros(len(present), np.int64)
    high[known] = np.cumsum(sizes[own])
    low[known] = high[known] - sizes[own]
    window, _ = _spread(plan.cuts[known].astype(np.int64), plan.cuts[known + 1].astype(np.int64))
    for j in range(plan.order.shape[1]):  # windows of which the segment has every term
        window = window[(plan.length[window] <= j) | present[plan.terms[np.minimum(plan.begin[window] + plan.order[window, j], len(plan.terms) - 1)]]]
    rarest = plan.terms[plan.begin[window] + plan.order[window, 0]]
    ahead = np.cumsum(high[rarest] - low[rarest])
    i = 0
    while i < len(window):
        k = max(i + 1, int(np.searchsorted(ahead, (ahead[i - 1] if i else 0) + _PAIRS, "right")))
        at, of = _spread(low[rarest[i:k]], high[rarest[i:k]])
        some = window[i:k][of]
        start = (keys[at] & 0xFFFFFFFF) - plan.order[some, 0]
        right = start >= 0
        some, start = some[right], start[right]
        for j in range(1, plan.order.shape[1]):
            check = np.flatnonzero(plan.length[some] > j)
            offset = plan.order[some[check], j].astype(np.int64)
            wanted = (plan.terms[plan.begin[some[check]] + offset].astype(np.int64) << 32) + start[check] + offset
            found = np.searchsorted(keys, wanted)
            right = np.ones(len(some), bool)
            right[check] = keys[np.minimum(found, len(keys) - 1)] == wanted
            if slop:
                near = (np.abs(keys[np.minimum(found, len(keys) - 1)] - wanted) <= slop) | (np.abs(keys[np.maximum(found - 1, 0)] - wanted) <= slop)
                right[check] |= near
            some, start = some[right], start[right]
        yield some, start
        i = k


def search(index: DataFrame, plan: Plan, slop: int = 0, digests: bool = False) -> DataFrame:
    """For each document of the index: segment, at (its number there), doc_id, n_words, hits, items.

    ``hits`` is a bitmap of the words inside a match (low bit first, cut after
    the last hit), ``items`` the sorted ids of the items that match.  A match
    lies in one document.  With ``slop``, the words of a window from its first
    to its last place count as hit.  With ``digests``, rows as ``contamination``
    has them, made by the same Python worker: a second Python step in a stage
    doubles the workers of an executor.
    """
    broadcast = index.sparkSession.sparkContext.broadcast(plan)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = broadcast.value
        for batch in batches:
            for i in range(batch.num_rows):
                n_words = np.frombuffer(batch.column("counts")[i].as_buffer(), "<u4").astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n_words)])
                sizes, positions = (W.from_planes(batch.column(c)[i].as_buffer(), "<u4") for c in ("sizes", "positions"))
                hit, pairs = np.zeros(first[-1] + 1, np.int32), [np.empty(0, np.int64)]
                for window, start in _matches(held, _terms(batch.column("terms"), i), sizes, positions, slop):
                    doc = np.searchsorted(first, start, "right") - 1
                    end = start + held.length[window]
                    inside = end <= first[np.minimum(doc + 1, len(n_words))]
                    np.add.at(hit, start[inside], 1)
                    np.subtract.at(hit, end[inside], 1)
                    pairs.append(np.unique(doc[inside] * len(held.items) + held.item[window[inside]]))
                covered = np.cumsum(hit)[:-1] > 0
                items: list[list[str]] = [[] for _ in n_words]
                for d, item in zip(*np.divmod(np.unique(np.concatenate(pairs)), max(1, len(held.items))), strict=True):
                    items[d].append(held.items[item])
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([batch.column("segment")[i].as_py()] * len(n_words), pa.int64()), "at": pa.array(np.arange(len(n_words), dtype=np.int32)),
                    "doc_id": batch.column("docs")[i].values, "n_words": pa.array(n_words),
                    "hits": pa.array([np.packbits(covered[a:b], bitorder="little").tobytes().rstrip(b"\0") if items[d] else b"" for d, (a, b) in enumerate(zip(first, first[1:], strict=False))], pa.binary()),
                    "items": pa.array(items, pa.list_(pa.string())),
                })
        W.give_back()

    return index.mapInArrow(lambda batches: _digest(find(batches)), _DIGESTS) if digests else index.mapInArrow(find, _FOUND)


_FOUND = "segment long, at int, doc_id long, n_words long, hits binary, items array<string>"
_DIGESTS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("items").to_pylist()
        hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in batch.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in hits]),
        ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def search_benchmark(index: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, item: str = "item_id", item_text: str = "text", digests: bool = False) -> DataFrame:
    """``search`` for all windows of a benchmark of any size, a part of it at once; each part reads the same index."""
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    passes = max(1, math.ceil(n_bytes / _PASS_BYTES))
    found = None
    for k in range(passes):
        some = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        part = search(index, Plan.of([tuple(r) for r in some.collect()], n, lambda terms: term_counts(index, terms)), slop, digests and passes == 1)  # about _PASS_BYTES are collected
        found = part if found is None else found.unionAll(part)
    if passes == 1:
        return found
    merged = found.groupBy("segment")
    return merged.applyInArrow(lambda rows: pa.Table.from_batches(_digest(iter(_merge(rows).to_batches()))), _DIGESTS) if digests else merged.applyInArrow(_merge, _FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; items without words match nothing, as does an
    empty benchmark.  Rows that repeat a document id are judged separately;
    rows that repeat an item id are one item.  Null item ids count as the
    item "None".  A text of any length is searched whole, as a segment of its
    own.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return search_benchmark(build_index(docs, id, text), benchmark, n, slop, item, item_text, digests=True)


def _merge(rows: pa.Table) -> pa.Table:
    """A segment's documents with the findings of all passes."""
    at = rows.column("at").to_numpy()
    first = {}
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = {}
    for i, (d, x, names) in enumerate(zip(at.tolist(), rows.column("hits").to_pylist(), rows.column("items").to_pylist(), strict=True)):
        first.setdefault(d, i)
        items.setdefault(d, set()).update(names)
        bits, more = hits.get(d, np.empty(0, np.uint8)), np.frombuffer(x, np.uint8)
        joined = np.zeros(max(len(bits), len(more)), np.uint8)
        joined[: len(bits)] = bits
        joined[: len(more)] |= more
        hits[d] = joined
    kept = rows.take(list(first.values())).select(["segment", "at", "doc_id", "n_words"])
    return kept.append_column("hits", pa.array([hits[d].tobytes() for d in first], pa.binary())).append_column("items", pa.array([sorted(items[d]) for d in first], pa.list_(pa.string())))
