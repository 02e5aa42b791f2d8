"""Toxicity by logistic regression over hashed words, word pairs and skip pairs.

Features are the distinct words, neighbouring pairs and pairs around one word
of a whole text, hashed to ``2**bits`` coordinates.  Weights are learned by
FTRL-proximal: every coordinate has its own rate, and the L1 term keeps all
but clearly useful weights at zero, so the model is a short list of (coordinate,
weight) that is broadcast to score any number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikv.llm import words as W
from lexikv.workspace import small_batches


class Settings(NamedTuple):
    bits: int = 18  #: coordinates; bounds the model at 2**bits weights
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 2
    sample_rows: int = 20_000  #: labelled rows to learn from, the first by a hash of their id


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every word, pair and skip pair, and the row of each; repeats stay."""
    w = W.scan(texts, W.ALNUM)
    row = np.repeat(np.arange(len(w.counts)), w.counts)
    h, found, rows = w.hash, [w.hash], [row]
    for gap in (1, 2):
        same = row[:-gap] == row[gap:]
        found.append(W.mix(h[:-gap] * W.salt(gap) + h[gap:])[same])
        rows.append(row[:-gap][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal with per-coordinate rates for 0/1 features; the last coordinate is the bias."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.s.l1, 0.0, (np.sign(z) * self.s.l1 - z) / ((self.s.beta + np.sqrt(n)) / self.s.alpha + self.s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: the distinct coordinates of an example."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


class Model(NamedTuple):
    bits: int
    bias: float
    at: np.ndarray  #: coordinates with a weight, sorted
    weight: np.ndarray


def train(docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled documents for which ``held_out`` (over ``id``) is false.

    At most ``sample_rows`` labelled rows are used, chosen by a hash of the id.
    Tasks over the documents turn each into its distinct coordinates, at most
    ``2**bits`` whatever its length; one task learns from these in the order of
    the hash, ``epochs`` times, reading them as a stream.  Null labels and
    labels without a document are passed over; a null text is empty; rows that
    repeat an id are examples of their own, within ``sample_rows``.  Without
    any label the model gives 0.5 for every text.
    """
    small_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).filter(~F.coalesce(held_out, F.lit(False))).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64(id).alias("_order")).orderBy("_order", "_id", "_label").limit(settings.sample_rows)
    # bounded by sample_rows
    joined = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").select("_order", "_label", "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "_text", 1 << 20):
            at, row = features(batch.column("_text"), settings.bits)
            pairs = np.unique((row << settings.bits) + at)
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) << settings.bits)
            at = (pairs & ((1 << settings.bits) - 1)).astype("<u4")
            # as differences, most of which fill one byte of four
            packed = [W.planes(np.diff(at[a:b], prepend=at.dtype.type(0))) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_label"), pa.array(packed, pa.binary())], ["_order", "_label", "_at"])

    order = ["_order", "_label", F.xxhash64("_at")]
    examples = joined.mapInArrow(hashed, "_order long, _label int, _at binary").orderBy(*order).limit(settings.sample_rows)
    epochs = examples.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.lit(settings.epochs))))
    stream = epochs.repartition(1).sortWithinPartitions("_epoch", *order).select("_label", "_at")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(settings)
        for batch in batches:
            for y, at in zip(batch.column("_label").to_pylist(), batch.column("_at"), strict=True):
                model.learn(np.cumsum(W.from_planes(at.as_buffer(), "<u4"), dtype=np.int64), y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_pydict({"bias": [float(w[-1])], "at": [at.tolist()], "weight": [w[at].tolist()]})

    found = stream.mapInArrow(learn, "bias double, at array<long>, weight array<double>").first()  # at most 2**bits weights
    return Model(settings.bits, found["bias"] if found else 0.0, np.array(found["at"] if found else [], np.int64), np.array(found["weight"] if found else [], float))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of each text."""
    at, row = features(texts, model.bits)
    dense = np.zeros(1 << model.bits)
    dense[model.at] = model.weight
    used = np.flatnonzero(dense[at])
    pairs = np.unique(row[used] * (1 << model.bits) + at[used])
    total = model.bias + np.bincount(pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with columns score (0 to 1) and predicted (1 if score >= ``threshold``).

    A null or empty text has the score of the bias alone.  Columns of ``docs``
    of those names are replaced.  A text of any length is scored whole, alone
    in its slice of a batch.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of_text(texts: pa.Array) -> pa.Array:
        parts = W.slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t", 1 << 20)
        return pa.array(np.concatenate([np.empty(0), *(scores(p.column("t"), held.value) for p in parts)]))

    return docs.withColumn("score", of_text(F.col(text).cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def id_hash(id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % modulus
