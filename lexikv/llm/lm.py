"""Log-probabilities of texts by a weighted backoff automaton learned from the corpus.

States are the word contexts seen in training: the empty one, each word, and
(for orders above two) each longer run.  A state has an arc for every word
seen after it, and a failure arc to the next shorter context, whose weight
pays for what the arcs leave over.  Scoring is one pass from left to right
that carries the state of each text: follow the arc of the next word, or
failure arcs until there is one.

Probabilities are smoothed with a Dirichlet prior: a context of c occurrences
gives word w the probability (c(context, w) + mu * P(w | shorter)) / (c + mu).
The empty context leaves to all unknown words together the share that words
seen once have in training.  Each context's probabilities sum to one over the
known words, the end and "unknown".

Nothing of the model passes through the driver or is broadcast.  Texts are
dealt into blocks of bounded size.  A block sends its distinct words and pairs
with their training counts to buckets of the hash space, and gets their corpus
counts back with a mark for those that other blocks have too.  Only a longer
run whose parts all bear that mark can occur elsewhere, so only such runs are
sent in their turn; the block's own counts are right for the others.  With the
counts a block builds just the part of the automaton that its texts can reach.

Bytes sent grow with the text; rows sent are blocks times buckets, of
``bucket_keys`` / blocks runs each.  At 100 TB, set ``block_bytes`` to 256 MB
and ``bucket_keys`` to 20 million on executors of 16 GB, so that rows hold
dozens of runs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from lexikv.llm import words as W
from lexikv.workspace import dropping_shuffles, settle, small_batches


class Settings(NamedTuple):
    order: int = 3
    mu: float = 100.0  #: strength of the prior
    block_bytes: int = 5 << 20  #: text of a block
    bucket_keys: int = 1_500_000  #: about so many (block, run) counts meet in one task


_END, _START = W.salt(1), W.salt(2)
_NONE, _BEGIN = 0, 1  # numbers of the empty run and of the start


class _Block:
    """Tokens of a block's texts, and its distinct runs of up to ``order`` tokens.

    Runs are numbered: the empty one, the start, then those of one token by
    their hash, those of two, and so on.
    """

    def __init__(self, texts: pa.Array, order: int) -> None:
        w = W.scan(texts)
        self.n_tokens = w.counts + 1
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        token = np.full(int(self.n_tokens.sum()), _END, np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[self.first + w.counts] = False
        token[is_word] = w.hash
        self.place = (np.arange(len(token)) - np.repeat(self.first, self.n_tokens)).astype(np.int32)
        self.keys: list[np.ndarray] = []
        self.base = [2]
        self.runs = np.zeros((order, len(token)), np.int32)  # the run of n tokens that ends at each; 0 where it reaches before the start
        run = token
        for n in range(1, order + 1):
            if n > 1:  # the start stands before the first token
                before = np.concatenate([[np.uint64(0)], run[:-1]])
                before[self.place == 0] = _START
                run = W.mix(before * W.salt(10) + token * W.salt(11) + W.salt(20 + n))
            there = np.flatnonzero(self.place >= n - 2)
            keys, at = np.unique(run[there], return_inverse=True)
            self.runs[n - 1, there] = at + self.base[-1]
            self.keys.append(keys)
            self.base.append(self.base[-1] + len(keys))

    def training_counts(self, learn: np.ndarray) -> np.ndarray:
        use = np.repeat(learn, self.n_tokens)
        counts = np.zeros(self.base[-1], np.int64)
        for n, run in enumerate(self.runs):
            counts[self.base[n] : self.base[n + 1]] = np.bincount(run[use], minlength=self.base[n + 1])[self.base[n] : self.base[n + 1]]
        counts[_BEGIN] = learn.sum()
        return counts

    def before(self, n: int) -> np.ndarray:
        """The run of n - 1 tokens that ends before each token."""
        out = np.concatenate([[np.int32(_NONE)], self.runs[n - 2][:-1]])
        out[self.place == 0] = _BEGIN if n == 2 else _NONE
        return out

    def elsewhere(self, n: int, shared: np.ndarray) -> np.ndarray:
        """Which runs of n tokens may occur in other blocks, by their number: those whose two parts do."""
        possible = np.zeros(self.base[n] - self.base[n - 1], bool)
        run = self.runs[n - 1]
        found = run[(run > 0) & shared[self.before(n)] & shared[self.runs[n - 2]]]
        possible[found - self.base[n - 1]] = True
        return possible


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.  States are numbers of runs in the block."""

    def __init__(self, block: _Block, counts: np.ndarray, s: Settings, n_train: int, n_once: int) -> None:
        runs = block.runs
        unknown = (n_once + 1) / (n_train + 2) if n_train else 1.0
        p = np.full(len(counts), unknown)  # of the last token of each run, given the others
        words = np.arange(block.base[0], block.base[1])
        seen = words[counts[words] > 0]
        p[seen] = (1 - unknown) * counts[seen] / max(1, n_train)
        self.fail_state = np.full(len(counts), _NONE, np.int32)
        self.fail_weight = np.zeros(len(counts))
        self.usable = np.zeros(len(counts), bool)
        for n in range(2, s.order + 1):
            # where each run of n tokens occurs
            at = np.zeros(block.base[n] - block.base[n - 1], np.int64)
            there = np.flatnonzero(runs[n - 1])
            at[runs[n - 1][there] - block.base[n - 1]] = there
            run, shorter, context = np.arange(block.base[n - 1], block.base[n]), runs[n - 2][at], block.before(n)[at]
            has = counts[run] > 0
            p[run] = np.where(has, (counts[run] + s.mu * p[shorter]) / (counts[context] + s.mu), 0)
            self.usable[run[has]] = True
            # failure arcs of the contexts of this length
            live = context[counts[context] > 0]
            self.fail_weight[live] = np.log10(s.mu / (counts[live] + s.mu))
            if n < s.order:
                self.fail_state[run] = shorter
        self.counts = counts
        with np.errstate(divide="ignore"):
            self.log_p = np.log10(p)

    def scores(self, block: _Block, order: int) -> np.ndarray:
        """One left-to-right pass over all texts of the block at once.

        ``level`` is the number of tokens in each text's state: at each step it
        is the longest context that training has seen.
        """
        total = np.zeros(len(block.n_tokens))
        by_length = np.argsort(-block.n_tokens, kind="stable")
        lengths, level = block.n_tokens[by_length], np.minimum(1, order - 1) * (self.counts[[_BEGIN]] > 0).repeat(len(by_length))
        state = np.where(level > 0, _BEGIN, _NONE)
        active = len(by_length)
        for step in range(int(lengths[0]) if active else 0):
            while lengths[active - 1] <= step:
                active -= 1
            at = block.first[by_length[:active]] + step
            state, level = state[:active], level[:active]
            gain = np.zeros(active)
            failing = np.flatnonzero(level > 0)
            while len(failing):  # no arc for the token: to the shorter context
                failing = failing[~self.usable[block.runs[level[failing], at[failing]]]]
                gain[failing] += self.fail_weight[state[failing]]
                state[failing] = self.fail_state[state[failing]]
                level[failing] -= 1
                failing = failing[level[failing] > 0]
            gain += self.log_p[block.runs[level, at]]
            total[by_length[:active]] += gain
            # the new context: the run just read, cut to order - 1 tokens, if training has seen it
            level = np.minimum(level + 1, order - 1)
            state = np.where(level > 0, block.runs[np.maximum(level - 1, 0), at], _NONE)
            unseen = np.flatnonzero((level > 0) & (self.counts[state] == 0))
            while len(unseen):
                level[unseen] -= 1
                state[unseen] = np.where(level[unseen] > 0, block.runs[np.maximum(level[unseen] - 1, 0), at[unseen]], _NONE)
                unseen = unseen[(level[unseen] > 0) & (self.counts[state[unseen]] == 0)]
        return total


def _chunks(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, by their top bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    return [(int(bucket[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


_SENT = "n int, bucket long, block long, keys binary, counts binary"
_ANSWER = "n int, bucket long, block long, counts binary, tokens long, distinct long, once long"


def _messages(n: int, block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """Sorted keys with their counts, a row for each bucket; high bytes of differences are mostly 0, which shuffles compress."""
    parts = _chunks(keys, 64 - bits)
    return pa.table({
        "n": pa.array([n] * len(parts), pa.int32()), "bucket": pa.array([k for k, _, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()),
        "keys": pa.array([W.planes(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in parts], pa.binary()), "counts": pa.array([W.planes(counts[a:b].astype("<u4")) for _, a, b in parts], pa.binary()),
    })


def _add_up(sent: pa.Table) -> pa.Table:
    """To each message of a bucket: twice the corpus count of each key, and one more if several blocks have it.

    For words, a row without a block has the bucket's training tokens, distinct
    words and words seen once.
    """
    keys = [np.cumsum(W.from_planes(x.as_buffer(), "<u8"), dtype=np.uint64) for x in sent.column("keys")]
    counts = np.concatenate([W.from_planes(x.as_buffer(), "<u4") for x in sent.column("counts")])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, blocks = np.bincount(at, counts).astype("<u8"), np.bincount(at)
    answer = (2 * total + (blocks > 1)).astype("<u8")[at]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    n, bucket, rows = sent.column("n")[0].as_py(), sent.column("bucket")[0].as_py(), sent.num_rows
    used = total[total > 0]
    sums = [int(used.sum()), len(used), int((used == 1).sum())]
    return pa.table({
        "n": pa.array([n] * (rows + 1), pa.int32()), "bucket": pa.array([bucket] * (rows + 1), pa.int64()), "block": pa.array([*sent.column("block").to_pylist(), None], pa.int64()),
        "counts": pa.array([*(W.planes(x) for x in np.split(answer, cuts)), None], pa.binary()), **{c: pa.array([0] * rows + [x if n == 1 else 0], pa.int64()) for c, x in zip(("tokens", "distinct", "once"), sums, strict=True)},
    })


def _corpus_counts(block: _Block, own: np.ndarray, answers: pa.Table, up_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the block's runs of up to so many tokens, and which of them other blocks have."""
    counts, shared = own.copy(), np.zeros(len(own), bool)
    n_of, buckets = answers.column("n").to_numpy(), answers.column("bucket").to_numpy()
    for n in range(1, up_to + 1):
        rows = np.flatnonzero(n_of == n)
        rows = rows[np.argsort(buckets[rows])]
        got = np.concatenate([np.empty(0, np.uint64), *(W.from_planes(answers.column("counts")[int(i)].as_buffer(), "<u8") for i in rows)]).astype(np.int64)
        asked = np.arange(block.base[n - 1], block.base[n])
        if n > 2:
            asked = asked[block.elsewhere(n, shared)]
        counts[asked], shared[asked] = got >> 1, got & 1 > 0
        if n == 1:
            end = np.searchsorted(block.keys[0], _END)
            counts[_BEGIN], shared[_BEGIN] = counts[block.base[0] + end], True  # a start for each end
    return counts, shared


def score_texts(df: DataFrame, held_out: Column, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` is false or null, and scores
    all.  Tokens are runs of other bytes than 20 and 09-0D, A-Z lower-cased,
    and one end.  ``score`` is the model's log10 probability of the text,
    ``base_score`` that of single tokens with one added to each count.  A null
    text is empty: its end alone.  Rows that repeat an id are scored
    separately.  A very long text is scored whole and makes its block larger.
    Without training rows all tokens are unknown and both scores are 0.  Other
    columns are ignored.
    """
    small_batches(df.sparkSession)
    s = settings
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_bytes // s.block_bytes))
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / 6 / s.bucket_keys))))
    # by text too, so that rows of one id spread
    grouped = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).groupBy("block")

    def own(texts: pa.Table) -> tuple[_Block, np.ndarray]:
        block = _Block(texts.column("text"), s.order)
        return block, block.training_counts(~texts.column("held_out").to_numpy().astype(bool))

    def send(texts: pa.Table) -> pa.Table:
        block, counts = own(texts)
        number = texts.column("block")[0].as_py()
        return pa.concat_tables([_messages(n, number, block.keys[n - 1], counts[block.base[n - 1] : block.base[n]], max(0, bits - 3 * (n == 1))) for n in range(1, min(2, s.order) + 1)])

    def send_longer(n: int):
        def send_runs(texts: pa.Table, answers: pa.Table) -> pa.Table:
            block, counts = own(texts)
            _, shared = _corpus_counts(block, counts, answers, n - 1)
            possible = block.elsewhere(n, shared)
            return _messages(n, texts.column("block")[0].as_py(), block.keys[n - 1][possible], counts[block.base[n - 1] : block.base[n]][possible], bits)

        return send_runs

    def answered(sent: DataFrame) -> DataFrame:
        with dropping_shuffles(df.sparkSession):  # texts and messages, several times the text; only the answers are read again
            return settle(sent.groupBy("n", "bucket").applyInArrow(_add_up, _ANSWER), "lm-counts")

    answers = answered(grouped.applyInArrow(send, _SENT))
    n_train, distinct, once = answers.filter("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "once"))).first()

    def of_block() -> GroupedData:
        return answers.filter("block is not null").select("n", "bucket", "block", "counts").groupBy("block")

    for n in range(3, s.order + 1):
        longer = grouped.cogroup(of_block()).applyInArrow(send_longer(n), _SENT)
        answers = answers.unionAll(answered(longer))

    def score(texts: pa.Table, got: pa.Table) -> pa.Table:
        block, counts = own(texts)
        counts, _ = _corpus_counts(block, counts, got, s.order)
        total = Automaton(block, counts, s, n_train, once).scores(block, s.order)
        known = counts[block.runs[0]]
        base = np.add.reduceat(np.log10((known + 1) / (n_train + distinct + 1)), block.first)
        out = pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(block.n_tokens), "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), block.first)),
            "train_tokens": pa.array([n_train] * len(total), pa.int64()), "base_score": pa.array(base), "score": pa.array(total),
        })
        W.give_back()
        return out

    return grouped.cogroup(of_block()).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
