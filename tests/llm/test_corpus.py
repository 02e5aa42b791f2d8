import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexikv.llm import components, decontaminate, near_dup, packing, sharding, token_store
from tests.llm import brute
from tests.llm.conftest import SF, make_docs, sentences

ITEMS = "item_id long, text string, doc_id long"


def _sorted(rows):
    return sorted((tuple((x is None, x) for x in r) for r in rows), key=str)


def test_contamination_equals_brute_force(spark, odd_rows, odd_docs):
    items = [(1, sentences(3, 24)), (2, "One  two"), (3, None), (4, ""), (5, sentences(7, 12)), (5, sentences(44, 15)), (6, "never seen words here"), (None, sentences(9, 11))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    want = brute.contamination([(i, t) for i, t, _ in odd_rows], items)
    assert sum(r[-1] for r in want) > 3
    assert _sorted(decontaminate.contamination(odd_docs, bench).collect()) == _sorted(want)


def test_contamination_in_several_passes(spark, odd_rows, odd_docs, monkeypatch):
    items = [(i, sentences(i, 30)) for i in range(12)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    once = _sorted(decontaminate.contamination(odd_docs, bench).collect())
    monkeypatch.setattr(decontaminate, "_PASS_BYTES", 700)
    assert _sorted(decontaminate.contamination(odd_docs, bench).collect()) == once == _sorted(brute.contamination([(i, t) for i, t, _ in odd_rows], items))


def test_contamination_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, none).collect())


def test_proximity(spark):
    docs = make_docs(spark, [(1, "x red big fox runs y", "s"), (2, "red extra big fox runs", "s"), (3, "fox big red runs far away", "s")])
    bench = spark.createDataFrame([(1, "red big fox runs", 1)], ITEMS)
    exact = {r.doc_id for r in decontaminate.contamination(docs, bench).filter("contaminated").collect()}
    near = {r.doc_id for r in decontaminate.contamination(docs, bench, slop=1).filter("contaminated").collect()}
    assert exact == {1}
    assert near == {1, 2}


@pytest.mark.parametrize("limits", [{}, {"leaf": 8, "few": 3, "levels": 2, "cluster_docs": 10}])
def test_near_duplicates_equal_brute_force(spark, odd_rows, odd_docs, limits):
    extra = []
    for base in range(6):  # groups of near copies of several sizes, and a passage that many share
        words = sentences(100 + base, 240).split()
        for k in range(3 + 9 * base):
            copy = list(words)
            copy[(7 * k) % 240] = f"edit{k}"
            if k % 5 == 0:
                copy[40] = f"more{k}"
            extra.append((1000 + 100 * base + k, " ".join(copy), "s"))
    shared = sentences(77, 30)
    extra += [(3000 + k, f"{shared} {sentences(3000 + k, 25)}", "s") for k in range(80)]
    docs = make_docs(spark, extra).unionAll(odd_docs)
    s = near_dup.Settings(percent=85, **limits)
    out = near_dup.near_duplicates(docs, s).collect()
    want = brute.near_duplicates([(i, t) for i, t, _ in [*extra, *odd_rows] if i is not None], 85)
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert max(Counter(x[1] for x in want.values()).values()) >= 40


def test_near_duplicates_of_an_empty_table(spark, no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.near_duplicates(make_docs(spark, [(1, None, "s"), (2, "", "s")])).filter("kept").count() == 2


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 1000), (3, 2)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 200, 1000: 200}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), 32)
    room, opened = [], []  # a plain best fit
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(32 - n)
            opened.append(n)
    assert (bins.max(initial=-1) + 1) == len(room)
    used = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        used[b].append((o, n))
    for parts in used.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 32


def test_pack(spark, odd_rows, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(odd_docs, path, window=128, block_pieces=20).collect()
    assert packing.pack(no_docs, path).count() == 0
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in odd_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 128):
            want[i, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 128


def test_interleave(spark, odd_docs, no_docs):
    out = sharding.interleave(odd_docs, 4).collect()
    assert len(out) == odd_docs.count()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    assert sharding.interleave(no_docs, 4).count() == 0
    assert {r.shard for r in sharding.interleave(odd_docs.limit(2), 16).collect()} == {0, 1}


def test_interleave_equals_brute_force(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append((hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest(), r.doc_id))
    phase = lambda s: int(hashlib.md5(f"7:{s}".encode()).hexdigest()[:8], 16) / 2**32
    order = sorted(((k + phase(s)) / len(v), s, h, i) for s, v in by.items() for k, (h, i) in enumerate(sorted(v)))
    small, extra = divmod(len(order), 16)
    want = {}
    for position, (_, _, _, i) in enumerate(order):
        shard = position // (small + 1) if position < extra * (small + 1) else extra + (position - extra * (small + 1)) // small
        want[i] = (shard, sum(1 for x in want.values() if x[0] == shard))
    out = sharding.interleave(docs, 16)
    assert {r.doc_id: (r.shard, r.slot) for r in out.collect()} == want
    held = Counter((r.shard, r.source) for r in out.collect())
    for source, rows in by.items():  # the hot one, two thirds of all, takes up what the twenty others are off
        assert all(abs(held[shard, source] - len(rows) / 16) <= (3 if source == "hot" else 1) for shard in range(16)), source


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50), max_size=6), st.data())
def test_dac_round_trip(tmp_path_factory, docs, data):
    uri = f"file://{tmp_path_factory.mktemp('dac')}/x.dac"
    writer = token_store.DacWriter()
    writer.add([None if i == 1 else i for i in range(len(docs))], [np.array(d, "<u4").tobytes() for d in docs])
    writer.write(uri)
    flat = [x for d in docs for x in d]
    with token_store.DacReader(uri) as dac:
        assert dac.n_ids == len(flat)
        assert [dac.document(i).tolist() for i in range(len(docs))] == docs
        if flat:
            i = data.draw(st.integers(0, len(flat) - 1))
            assert dac.token(i) == flat[i]


def test_dac_rank_at_block_borders(tmp_path):
    ids = np.arange(20_000, dtype="<u4") % 700
    writer = token_store.DacWriter()
    writer.add([0], [ids.tobytes()])
    writer.write(f"file://{tmp_path}/x.dac")
    with token_store.DacReader(f"file://{tmp_path}/x.dac") as dac:
        for a, b in [(0, 20_000), (4096, 8192), (4095, 4097), (8191, 8192), (12_288, 12_289), (19_999, 20_000)]:
            assert (dac.read(a, b) == ids[a:b]).all()


def test_token_files(spark, odd_rows, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_store.write_tokens(odd_docs, path, 1, file_bytes=100_000)
    assert files.count() > 1
    out = token_store.read_documents(files).collect()
    library = Tokenizer.from_file(path)
    ids = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t, _ in odd_rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i or 0))
    assert token_store.read_documents(token_store.write_tokens(no_docs, path, 1)).count() == 0


def test_one_index_serves_any_benchmark(spark, odd_rows, odd_docs):
    index = decontaminate.build_index(odd_docs)
    for items in ([(1, sentences(3, 24)), (2, "One  two")], [(7, sentences(9, 11))], []):
        bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
        want = Counter((r[0], tuple(r[4].split(","))) for r in _with_items(odd_rows, items))
        found = decontaminate.search_benchmark(index, bench).collect()
        assert Counter((r.doc_id, tuple(r["items"] or [""])) for r in found) == want


def _with_items(rows, items):
    """Document id and the items of which it has a window, comma-joined."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute_lower(t or ""))
    windows = {i: [" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))] if (w := words(t)) else [] for i, t in items}
    for i, text, _ in rows:
        held = f" {' '.join(words(text))} "
        yield i, None, None, None, ",".join(sorted(str(k) for k, ws in windows.items() if any(f" {x} " in held for x in ws)))


def brute_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_connected_sets_equal_brute_force():
    import random

    rng = random.Random(5)
    for percent in (80, 85):
        for _ in range(60):
            base = [rng.sample(range(400), 40) for _ in range(3)]
            sets = []
            for _ in range(rng.randint(2, 40)):
                some = set(rng.choice([*base, *map(list, sets)] if sets else base))
                for _ in range(rng.randint(0, 6)):
                    some ^= {rng.randrange(400)}
                sets.append(some or {1})
            n, part = len(sets), list(range(len(sets)))
            for i in range(n):
                for j in range(i):
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        a, b = part[i], part[j]
                        part = [min(a, b) if x in (a, b) else x for x in part]
            got = near_dup._connected([np.array(sorted(x), np.uint64) for x in sets], percent)
            assert got.tolist() == part


@pytest.mark.parametrize("limits", [{}, {"cluster_docs": 2, "few": 2}])
def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark, limits):
    a, b = sentences(3, 40), sentences(8, 40)
    docs = make_docs(spark, [(1, a, "s"), (5, a + " end", "s"), (5, b, "s"), (9, b + " end", "s"), (9, b + " end", "s")])
    out = near_dup.near_duplicates(docs, near_dup.Settings(**limits)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (5, 1), (5, 5), (9, 5), (9, 5)]
