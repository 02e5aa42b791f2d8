"""Near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles, seen through a fixed number of minwise
tokens.  Each of several independent trees branches the documents by a few
chosen tokens: those that share a token's value go down the same branch.  Nodes
with few documents are compared exhaustively by their tokens, and a spanning
forest of the likely pairs is kept.  A larger node first compares its documents
with one of them, the pivot.  If few are unlike it, these are compared with the
whole node, which ends it; else the node branches again.  Nodes left after the
last level are finished the same way, block by block, so no case depends on a
cap.

The forests' components are clusters; a similar pair is parted by them only
with the probability below.  All clusters are resolved exactly, on the full
sets of their documents.  One of bounded size is resolved by one task.  A
larger one is dealt to blocks.  First each block is compared with itself and
one other; then what isn't in the cluster's largest part so far, also dealt to
blocks, is compared with all blocks, a task for each two.  That is quadratic at
worst, but in parts of bounded size.

A pair at the threshold goes down each branch with that probability, so it is
lost where all roots, or all branches below each root that it shares, part it:
an extinct branching process, whatever the depth.  All trees compare the same
tokens with the same cut, which drops the pair with a binomial tail once for
all.  ``Settings.missed`` is the sum: 1.5e-7 at 0.85, 2.6e-8 at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikv.llm import words as W
from lexikv.llm.components import connected_components
from lexikv.workspace import dropping_shuffles, settle, small_batches


_MAP_ROWS = 1 << 20  # of two numbers each, at most about 32 MB to broadcast


class Settings(NamedTuple):
    words: int = 5
    percent: int = 80  #: link when 100 * intersection >= percent * union
    trees: int = 4
    branches: int = 3
    tokens: int = 64  #: minwise tokens of a document
    leaf: int = 8192  #: nodes of so many documents are compared exhaustively by tokens
    few: int = 64  #: documents unlike the pivot that are compared with a whole node
    cluster_docs: int = 16_384  #: clusters of so many documents,
    cluster_shingles: int = 4_000_000  #: and shingles,
    cluster_work: int = 1 << 34  #: and documents times shingles, are resolved by one task
    block_docs: int = 1024  #: blocks of about so many documents
    block_shingles: int = 1 << 19  #: and shingles are compared at once
    levels: int = 8

    @property
    def roots(self) -> int:
        return self.trees * self.branches

    @property
    def agree(self) -> int:
        """Tokens that must agree for a pair to be confirmed on its sets: 5.7 standard deviations below the mean at the threshold."""
        p = self.percent / 100
        return max(1, int(self.tokens * p - 5.7 * (self.tokens * p * (1 - p)) ** 0.5))

    @property
    def missed(self) -> float:
        """Bound of the probability that a pair at the threshold never meets in a small node or is dropped by ``agree``."""
        p = self.percent / 100
        lost = 0.0
        for _ in range(100):
            lost = (1 - p + p * lost) ** self.branches
        return (1 - p + p * lost) ** self.roots + sum(math.comb(self.tokens, k) * p**k * (1 - p) ** (self.tokens - k) for k in range(self.agree))


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted."""
    h, counts = W.shingles(W.scan(texts), n)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(h[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums over each set, which tell sets apart; 0 for an empty one."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), 2), np.int64)
    if sizes.sum():
        flat, some = np.concatenate(sets), np.flatnonzero(sizes)
        for i in range(2):
            out[some, i] = np.add.reduceat(W.mix(flat ^ W.salt(2000 + i)), (np.cumsum(sizes) - sizes)[some]).view(np.int64)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc and others) with the texts of ``doc``.

    A bit map of the wanted documents goes to the texts, 16 bits for each and
    of bounded size in all, so that few texts but the wanted ones are shuffled.
    """
    bits = 64 * max(1, min(wanted.count() // 4, _MAP_ROWS))
    bit = F.pmod(F.xxhash64("doc"), F.lit(bits))
    word, place = F.shiftright(bit, 6).alias("_word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("_place")
    held = wanted.select(word, place).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_bits"))
    near = docs.select("doc", "text", word, place).join(F.broadcast(held), "_word").filter(F.bit_get("_bits", "_place") == 1)
    return near.select("doc", "text").join(wanted, "doc")


def _made_sets(batches: Iterator[pa.RecordBatch], others: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, p1, p2 and others) whose text has these prints, with its set instead."""
    for batch in W.slices(batches, "text", 1 << 20):
        sets = _sets(batch.column("text"), n)
        prints = _prints(sets)
        own = np.flatnonzero((prints[:, 0] == batch.column("p1").to_numpy()) & (prints[:, 1] == batch.column("p2").to_numpy()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in others), pa.array([sets[i].tobytes() for i in own], pa.binary())], [*others, "set"])


def sketches(docs: DataFrame, s: Settings, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, p1 and p2 (a 128-bit print of the set), tokens (null for an empty set)."""
    factors = [W.salt(1000 + i) | np.uint64(1) for i in range(s.tokens)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", 1 << 20):
            sets = _sets(batch.column("text"), s.words)
            sizes = np.array([len(x) for x in sets])
            some = np.flatnonzero(sizes)
            tokens = np.zeros((len(sets), s.tokens), np.int32)
            prints = _prints(sets)
            if len(some):
                flat = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[some]
                for i, f in enumerate(factors):
                    tokens[some, i] = (np.minimum.reduceat(flat * f, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * s.tokens), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], ["doc_id", "n_shingles", "p1", "p2", "tokens"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, p1 long, p2 long, tokens array<int>")


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
        if cut == 0 and held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    W.give_back()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _leaf_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """Candidates (a, b) of small nodes (node, id, tokens): a spanning forest of each node's likely pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            nodes, ids, tokens = table.column("node").to_numpy(), table.column("id").to_numpy(), _matrix(table.column("tokens"), s.tokens)
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            left, right = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                # each document found is compared with those not found so far, which soon are few where most are alike
                rest, found = np.arange(lo, hi), []
                seen = np.ascontiguousarray(tokens[lo:hi].T)
                while len(rest):
                    if found:
                        i = found.pop()
                    else:
                        i, rest, seen = rest[0], rest[1:], seen[:, 1:]
                    like = (seen == tokens[i][:, None]).sum(0, dtype=np.uint16) >= s.agree
                    if like.any():
                        fresh = rest[like].tolist()
                        found += fresh
                        left += [ids[i]] * len(fresh)
                        right += ids[fresh].tolist()
                        rest, seen = rest[~like], seen[:, ~like]
            if left:
                x, y = np.array(left), np.array(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return members.select("node", "id", "tokens").repartition("node").sortWithinPartitions("node", "id").mapInArrow(compare, "a long, b long")


def _by_node(members: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Rows of ``members`` (node, id, size, ...) with what ``nodes`` (node, size, ...) has for their node, a large node in parts of about a leaf."""
    parts = F.ceil(F.col("size") / s.leaf)
    left = members.withColumn("_part", F.pmod(F.xxhash64("id"), parts))
    return left.join(nodes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("size"), ["node", "_part"]).drop("_part")


def _probe_pairs(probes: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Candidates of each node's probe documents (node, id, size, left, tokens), in blocks of about ``few``, against all of the node."""
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("left") / s.few)).alias("_block")
    blocks = probes.groupBy("node", "size", block).agg(F.collect_list(F.struct("id", "tokens")).alias("probes"))
    near = _by_node(members, blocks, s).select("id", F.explode(F.filter("probes", lambda p: _agreeing(F.col("tokens"), p["tokens"]) >= s.agree)).alias("p"))
    return near.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).filter("a < b")


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows (node, id) of nodes with two documents or more, with the node's size."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(sizes, "node")


def _walk(unique: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Candidates (a, b) from all trees; ``members``: the nodes at the roots."""
    tokens = settle(unique.join(members.select("id").distinct(), "id"), "tokens")
    found: list[DataFrame] = []
    for level in range(s.levels + 1):
        found.append(_leaf_pairs(members.filter(F.col("size") <= s.leaf).join(tokens, "id"), s))
        large = members.filter(F.col("size") > s.leaf)
        if large.isEmpty():
            break
        pivots = large.groupBy("node", "size").agg(F.min(F.struct(F.xxhash64("id", F.lit(level)).alias("h"), "id")).alias("p")).select("node", "size", F.col("p.id").alias("pivot"))
        pivots = pivots.join(tokens.withColumnsRenamed({"id": "pivot", "tokens": "pivot_tokens"}), "pivot")
        large = large.join(tokens, "id")
        near = _by_node(large, pivots, s).filter(_agreeing(F.col("tokens"), F.col("pivot_tokens")) >= s.agree)
        star = settle(near.select("node", "id", "pivot"), "star")
        found.append(star.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).filter("a < b").distinct())
        others = settle(large.join(star.select("node", "id"), ["node", "id"], "left_anti"), "others")
        counts = settle(others.groupBy("node", "size").agg(F.count("*").alias("left")), "counts")
        last = level == s.levels
        some = counts if last else counts.filter(F.col("left") <= s.few)
        found.append(_probe_pairs(_by_node(others, some, s), large, s))
        if last:
            break
        rest = _by_node(large, counts.filter(F.col("left") > s.few).drop("left"), s)
        # chosen tokens depend on the node, so that nodes branch independently; those of the roots are used up
        free = s.tokens - s.roots
        chosen = F.explode(F.array(*((F.lit(s.roots) + F.pmod(F.xxhash64("node", F.lit(level)) + F.lit(j * (free // s.branches)), F.lit(free))).cast("int") for j in range(s.branches)))).alias("c")
        branched = rest.select("node", "id", "tokens", chosen).select(F.xxhash64("node", "c", F.element_at("tokens", F.col("c") + 1)).alias("node"), "id")
        members = settle(_nodes(branched), "nodes")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return settle(out.distinct(), "candidates")


def _roots(unique: DataFrame, s: Settings) -> DataFrame:
    """Members (node, id, size) of the trees' first branches."""
    root = F.posexplode(F.slice("tokens", 1, s.roots)).alias("c", "v")
    return settle(_nodes(unique.select("id", root).select(F.xxhash64("c", "v").alias("node"), "id")), "nodes")


def _similar(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``x`` are similar to which of ``y``, exactly.

    Shingles that many sets have are counted by matrix products, the others
    pair by pair.
    """
    nx, ny = (np.array([len(a) for a in sets]) for sets in (x, y))
    if 100 * min(nx.max(), ny.max()) < percent * max(nx.min(), ny.min()):
        return np.zeros((len(x), len(y)), bool)
    distinct, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cx, cy = column[: nx.sum()], column[nx.sum() :]
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    ux, uy = (np.bincount(c, minlength=len(distinct)) for c in (cx, cy))
    many = 128 * ux * uy > len(x) * len(y)
    exact = np.float32 if min(nx.max(), ny.max()) < 1 << 24 else np.float64  # holds the whole numbers that occur
    both = np.zeros((len(x), len(y)), exact)
    dense, place = np.flatnonzero(many), np.cumsum(many) - 1
    for lo in range(0, len(dense), 1024):
        held = []
        for c, r, n in ((cx, rx, len(x)), (cy, ry, len(y))):
            own = many[c] & (place[c] >= lo) & (place[c] < lo + 1024)
            held.append(np.zeros((n, 1024), exact))
            held[-1][r[own], place[c[own]] - lo] = 1
        both += held[0] @ held[1].T
    order = np.argsort(cy, kind="stable")
    sorted_ry, starts = ry[order], np.cumsum(uy) - uy
    rare = np.flatnonzero(~many[cx] & (uy[cx] > 0))
    meets = np.cumsum(uy[cx[rare]])
    lo = 0
    while lo < len(rare):
        hi = max(lo + 1, int(np.searchsorted(meets, (meets[lo - 1] if lo else 0) + (1 << 20), "right")))
        at, n = rare[lo:hi], uy[cx[rare[lo:hi]]]
        other = sorted_ry[np.repeat(starts[cx[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both += np.bincount(np.repeat(rx[at] * len(y), n) + other, minlength=both.size).reshape(both.shape)
        lo = hi
    counts = both.astype(np.int64)
    return 100 * counts >= percent * (nx[:, None] + ny - counts)


def _merge(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts that the links (a, b) connect; ``first`` has the first member of each one's part."""
    while True:
        x, y = first[a], first[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(first, np.maximum(x, y), np.minimum(x, y))
        while (first != first[first]).any():
            first[:] = first[first]


def _connected(sets: list[np.ndarray], percent: int, docs: int = Settings().block_docs, shingles: int = Settings().block_shingles) -> np.ndarray:
    """For each set, the first in its component of similar sets, exactly.

    Blocks of sets are compared with themselves, then two by two; what two
    blocks have in one part already is not compared again.
    """
    first = np.arange(len(sets))
    total = np.cumsum([len(x) for x in sets])
    cuts = [0]
    while cuts[-1] < len(sets):
        lo = cuts[-1]
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + shingles, "right"))
        cuts.append(max(lo + 1, min(hi, lo + docs)))
    blocks = [np.arange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    for gap in range(len(blocks)):
        for i, j in zip(blocks, blocks[gap:], strict=False):
            parts, sizes = np.unique(first[np.append(i, j)], return_counts=True)
            most = parts[sizes.argmax()]
            out_i, out_j = i[first[i] != most], j[first[j] != most]
            for p, q in ((out_i, j), (i[first[i] == most], out_j)):
                if len(p) and len(q):
                    x, y = np.nonzero(_similar([sets[k] for k in p], [sets[k] for k in q], percent))
                    _merge(first, p[x], q[y])
    return first


def _resolve(docs: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """(node, component) of all documents of bounded clusters (id, doc, p1, p2, cluster): the least ids of exact components.

    Texts are sent to their cluster's task, which makes the sets; these are about twice as large.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(_made_sets(batches, ["cluster", "id"], s.words), "cluster"):
            fresh = np.append(True, np.diff(table.column("id").to_numpy()) != 0)  # rows that repeat an id and a text have equal sets
            table = table.filter(pa.array(fresh))
            cluster, ids = table.column("cluster").to_numpy(), table.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(ids)]
            least = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")[lo:hi]]
                least.append(ids[lo + _connected(sets, s.percent, s.block_docs, s.block_shingles)])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(least))], ["node", "component"])

    texts = _texts(docs, clusters.select("id", "doc", "p1", "p2", "cluster")).select("cluster", "id", "p1", "p2", "text")
    return texts.repartition("cluster").sortWithinPartitions("cluster", "id").mapInArrow(resolve, "node long, component long")


def _resolve_large(docs: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """(node, component) of the documents of clusters of any size (id, doc, p1, p2, n_shingles, cluster) that have a link: the least ids of exact components."""
    made = _texts(docs, clusters.select("id", "doc", "p1", "p2", "cluster")).select("cluster", "id", "p1", "p2", "text")
    made = made.mapInArrow(lambda batches: _made_sets(batches, ["cluster", "id"], s.words), "cluster long, id long, set binary")
    sets = settle(made.dropDuplicates(["id"]), "sets")  # rows that repeat an id and a text have equal sets

    def blocks(rows: DataFrame) -> DataFrame:
        """(cluster, number of blocks)."""
        size = F.greatest(F.ceil(F.count("*") / s.block_docs), F.ceil(F.sum("n_shingles") / s.block_shingles))
        return rows.groupBy("cluster").agg(size.alias("blocks"))

    def links(rows: DataFrame) -> DataFrame:
        """Spanning forests (a, b) of the links between the left and other rows (task, left, id, set) of each task."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _groups(batches, "task"):
                tasks, ids, left = (table.column(c).to_numpy() for c in ("task", "id", "left"))
                cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(ids)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")[lo:hi]]
                    p, q = np.flatnonzero(left[lo:hi]), np.flatnonzero(~left[lo:hi])
                    if not (len(p) and len(q)):
                        continue
                    # a document may be on both sides
                    own, first = np.unique(ids[lo:hi], return_inverse=True)
                    part = np.arange(len(own))
                    x, y = np.nonzero(_similar([sets[k] for k in p], [sets[k] for k in q], s.percent))
                    _merge(part, first[p[x]], first[q[y]])
                    hung = np.flatnonzero(part != np.arange(len(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[part[hung]]), pa.array(own[hung])], ["a", "b"])

        return rows.select("task", "left", "id", "set").repartition("task").sortWithinPartitions("task", "id").mapInArrow(compare, "a long, b long")

    def dealt(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows with the tasks (columns cluster, i, j) in which they are on the left or right."""
        rows = left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False)))
        return rows.withColumn("task", F.xxhash64("cluster", "i", "j"))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    all_blocks = settle(blocks(clusters), "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = sets.join(all_blocks, "cluster").withColumn("block", block)
    # each block with itself and the first one
    itself = placed.withColumn("i", F.col("block"))
    left = itself.withColumn("j", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), "block"))))
    right = itself.withColumn("j", F.col("block")).unionAll(placed.filter("block = 0").withColumn("i", numbers("blocks")).withColumn("j", F.lit(0).cast("long")).filter("i > 0"))
    some = settle(links(dealt(left, right)), "links")
    parts = settle(connected_components(some), "components")
    part = settle(clusters.select("cluster", "id", "n_shingles").join(parts.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"), "parts")
    most = part.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", "n").alias("part"))
    # what is in the largest part is connected; the others meet all
    others = settle(part.join(most, ["cluster", "part"], "left_anti"), "others")
    if others.isEmpty():
        return parts
    other_blocks = settle(blocks(others).withColumnRenamed("blocks", "others"), "blocks")
    placed = placed.join(other_blocks, "cluster")
    left = placed.join(others.select("id"), "id", "left_semi").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), F.col("others"))).withColumn("j", numbers("blocks"))
    right = placed.withColumn("i", numbers("others")).withColumn("j", F.col("block"))
    return connected_components(some.unionAll(settle(links(dealt(left, right)), "links")))


def similar_components(docs: DataFrame, unique: DataFrame, s: Settings) -> DataFrame:
    """(node, component) of those of ``unique`` (id, doc, p1, p2, tokens, n_shingles) that have a similar one.

    ``docs`` (doc, text) has their texts; one with the prints p1 and p2 is meant.
    """
    clusters = settle(connected_components(_walk(unique, _roots(unique, s), s)), "clusters").withColumnsRenamed({"node": "id", "component": "cluster"})
    held = settle(unique.drop("tokens").join(clusters, "id"), "held")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("n"))
    large = settle(sizes.filter((F.col("docs") > s.cluster_docs) | (F.col("n") > s.cluster_shingles) | (F.col("docs") * F.col("n") > s.cluster_work)).select("cluster"), "large")
    out = settle(_resolve(docs, held.join(large, "cluster", "left_anti").drop("n_shingles"), s), "components")
    if large.isEmpty():
        return out
    return out.unionAll(settle(_resolve_large(docs, settle(held.join(large, "cluster"), "own"), s), "components"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class from the start.  ``component_id``
    is the least id in all classes of a component; ``kept`` marks the rows that
    bear it.  A null or empty text, or one without words, is linked with
    nothing.  Rows that repeat an id are judged by their own texts; a row
    without id isn't compared, has a null component and is kept.  A text of
    any length is compared by all its shingles.  An empty table gives no rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    with dropping_shuffles(docs.sparkSession):
        drawn, placed = _placed(docs, texts, settings, id, text)
    least = placed.groupBy("of").agg(F.min("doc").alias("least"))
    named = placed.join(least, "of").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "least")
    out = drawn.join(named, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _placed(docs: DataFrame, texts: DataFrame, settings: Settings, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sketches, and their classes (p1, p2, n_shingles, doc) with their components (of)."""
    drawn = settle(sketches(docs, settings, id, text), "sketches")
    some = drawn.filter("doc_id is not null and n_shingles > 0")
    # numbered, as an id that repeats may stand for two classes; written out, so that the numbers stay
    classes = settle(some.groupBy("p1", "p2", "n_shingles").agg(F.min("doc_id").alias("doc")).withColumn("id", F.monotonically_increasing_id()), "classes")
    unique = some.withColumnRenamed("doc_id", "doc").join(classes, ["doc", "p1", "p2", "n_shingles"]).dropDuplicates(["id"])
    parts = similar_components(texts, settle(unique, "unique"), settings)
    return drawn, settle(classes.join(parts, classes["id"] == parts["node"], "left").select("p1", "p2", "n_shingles", "doc", F.coalesce("component", "id").alias("of")), "placed")
