"""Families of copies of copies: most pairs are somewhat alike, few are similar."""

import random

import numpy as np
import pytest

from lexikv.llm import near_dup


def family(seed, n, words=60, changes=4):
    rng = random.Random(seed)
    out = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    while len(out) < n:
        copy = list(rng.choice(out))
        for _ in range(rng.randint(1, changes)):
            copy[rng.randrange(words)] = f"w{rng.randrange(400)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def brute(texts, percent):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((part[i], part[j]))
                part = [a if x == b else x for x in part]
    return part


@pytest.mark.parametrize("docs, shingles", [(1024, 1 << 19), (50, 1 << 19), (7, 300)])
def test_blocks_of_sets_equal_brute_force(docs, shingles):
    texts = family(3, 300)
    words = [x.split() for x in texts]
    sets = [np.array(sorted({hash(tuple(w[i : i + 5])) % (1 << 64) for i in range(len(w) - 4)}), np.uint64) for w in words]
    assert near_dup._connected(sets, 80, docs, shingles).tolist() == brute(texts, 80)


def test_large_clusters_are_resolved_exactly_in_blocks(spark):
    texts = family(4, 250) + family(9, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for settings in ({}, {"cluster_docs": 8, "block_docs": 20}, {"cluster_docs": 8, "block_shingles": 1500}):
        out = near_dup.near_duplicates(docs, near_dup.Settings(**settings))
        assert [r.component_id for r in out.orderBy("doc_id").collect()] == brute(texts, 80)


def test_a_node_of_alike_documents_is_left_after_few_comparisons(spark):
    """They aren't branched, which multiplied them with every level, and give one tree."""
    rng, n = random.Random(1), 3000
    base = [rng.randrange(1 << 30) for _ in range(64)]
    rows = [(7, i, [x if rng.random() < 0.85 else rng.randrange(1 << 30) for x in base], n) for i in range(n)]
    members = spark.createDataFrame(rows, "node long, id long, tokens array<int>, size long")
    s = near_dup.Settings()
    assert n <= s.leaf
    pairs = near_dup._leaf_pairs(members, s).collect()
    assert len(pairs) == n - 1 and {x for r in pairs for x in (r.a, r.b)} == set(range(n))
