"""Words of whole text columns as numpy arrays, straight from Arrow buffers.

A word is a maximal run of word bytes inside one row; A-Z count as a-z.  Words
are identified by a 64-bit hash: each (place, lower-cased byte) has a scrambled
64-bit number, a word has their sum, scrambled again.  Two given words differ
in numbers that have nothing to do with each other, so they share a hash with
probability 2**-64 whatever their letters, and some two of n words with about
n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexikv.workspace import give_back

_PIECE = 1 << 17
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space and the controls 09-0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Digits, letters and all bytes of multi-byte characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words(NamedTuple):
    start: np.ndarray  #: byte position in the column's data, inclusive
    end: np.ndarray  #: exclusive
    hash: np.ndarray  #: uint64
    counts: np.ndarray  #: words of each row


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salt(n: int) -> np.uint64:
    return mix(np.array([n * 0x2545F4914F6CDD1D + 1 & 0xFFFFFFFFFFFFFFFF], _U))[0]


def _numbers(place: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return mix((place.astype(_U) << _U(8) | letters) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))


_NEAR = 64  # places whose numbers are kept in a table
_TABLE = _numbers(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint8), _NEAR))


def _hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each of the words that ``letters`` holds one after the other; a very long word goes through in parts."""
    first = np.cumsum(lengths) - lengths
    total = np.zeros(len(lengths), _U)
    for a in range(0, len(letters), _PIECE):
        b = min(a + _PIECE, len(letters))
        lo, hi = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b))
        begin = np.maximum(first[lo:hi], a) - a
        place = np.arange(a, b) - np.repeat(first[lo:hi], np.diff(begin, append=b - a))
        part = letters[a:b]
        numbers = _TABLE[np.minimum(place, _NEAR - 1) * 256 + part]
        far = np.flatnonzero(place >= _NEAR)
        numbers[far] = _numbers(place[far], part[far])
        total[lo:hi] += np.add.reduceat(numbers, begin)
    return mix(total)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at.astype(np.int64)


def scan(column: pa.Array, word_bytes: np.ndarray = NOT_BLANK) -> Words:
    """All words of a string column, in order."""
    data, at = raw(column)
    first, last = int(at[0]), int(at[-1])
    row_start = np.zeros(last - first + 1, bool)
    row_start[at - first] = True
    starts, ends, hashes = [], [], []
    a = first
    while a < last:
        b = min(a + _PIECE, last)
        if b < last:  # cut where no word is cut
            cut = np.flatnonzero(~word_bytes[data[a:b]] | row_start[a - first : b - first])
            size = _PIECE
            while not len(cut) or cut[-1] == 0:
                size *= 2
                b = min(a + size, last)
                if b == last:
                    break
                cut = np.flatnonzero(~word_bytes[data[a:b]] | row_start[a - first : b - first])
            else:
                b = a + int(cut[-1])
        piece = data[a:b]
        inside, fresh = word_bytes[piece], row_start[a - first : b - first + 1]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:-1]
        stops[:-1] &= ~inside[1:] | fresh[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes.append(_hashes(LOWER[piece[inside]], e - s))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(start, at))
    return Words(start, np.concatenate(ends) if ends else start, np.concatenate(hashes) if hashes else np.empty(0, _U), counts)


def word_hash(word: str) -> int:
    """The hash that ``scan`` gives to ``word`` (a single word)."""
    return int(scan(pa.array([word]), np.ones(256, bool)).hash[0])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``n`` words, and their count by row.

    A row of fewer words, but not none, has one shingle: the whole row.
    Repeats inside a row stay.
    """
    h, counts = words.hash, words.counts
    first = np.concatenate([[0], np.cumsum(counts)])
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(out_counts)])[:-1], out_counts) + np.arange(out_counts.sum())
    length = np.repeat(np.minimum(counts, n), out_counts)
    total = length.astype(_U) * _U(0xA24BAED4963EE407)
    padded = np.concatenate([h, np.zeros(n, _U)])
    for j in range(n):
        term = padded[begin + j] * (salt(3000 + j) | _U(1))
        total += term if j == 0 else np.where(length > j, term, _U(0))
    return mix(total), out_counts


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: bytes that are mostly 0 stand together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes | pa.Buffer, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``budget`` bytes in each, or one row."""
    for batch in batches:
        _, at = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + budget, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back()
