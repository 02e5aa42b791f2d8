import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexikv.llm import words as W
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n.1　z", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
@pytest.mark.parametrize(("table", "pattern"), [(W.NOT_BLANK, brute.BLANK), (W.ALNUM, brute.ALNUM)])
def test_scan_finds_the_same_words(table, pattern, texts):
    column = pa.array([None, *texts], pa.string()).slice(1)  # with an offset
    found = W.scan(column, table)
    data, _ = W.raw(column)
    each = [brute.words(t, pattern) for t in texts]
    assert found.counts.tolist() == [len(w) for w in each]
    flat = [x for w in each for x in w]
    assert [bytes(W.LOWER[data[a:b]]) for a, b in zip(found.start, found.end, strict=True)] == flat
    same = {}
    for h, w in zip(found.hash.tolist(), flat, strict=True):
        assert same.setdefault(h, w) == w
    assert len(set(flat)) == len(same)


def test_scan_cuts_pieces_between_words(monkeypatch):
    text = "aa bbb c " * 50 + "d" * 500 + " e"
    whole = W.scan(pa.array([text, "", text]))
    monkeypatch.setattr(W, "_PIECE", 16)
    parts = W.scan(pa.array([text, "", text]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    hashes, counts = W.shingles(W.scan(pa.array(texts, pa.string())), 3)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert len(set(hashes[cuts[i] : cuts[i + 1]].tolist())) == len(brute.shingles(t, 3))


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, "b" * 5, None, "c" * 100, "d"]})
    parts = list(W.slices(iter([batch]), "t", 16))
    assert [p.num_rows for p in parts] == [3, 1, 1]


def test_words_without_structure_in_their_hash():
    word = "a"
    swap = str.maketrans("ab", "ba")
    while len(word) < 4096:  # Thue-Morse words and their complements meet in polynomial hashes modulo 2**64
        word += word.translate(swap)
    for n in (64, 1024, 2048, 4096):
        assert W.word_hash(word[:n]) != W.word_hash(word[:n].translate(swap))


def test_a_long_word_goes_through_in_parts():
    long = "xy" * 300_000
    w = W.scan(pa.array([f"a {long} b", long, "a b"]))
    assert w.counts.tolist() == [3, 1, 2]
    assert w.hash[1] == w.hash[3] != w.hash[0]
    assert (w.hash[0], w.hash[2]) == (w.hash[4], w.hash[5])
    assert W.word_hash(long) == w.hash[1]
