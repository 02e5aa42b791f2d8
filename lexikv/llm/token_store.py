"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of
every id and a bitmap that tells which ids go on; level 1 holds the next chunk
of those alone, and so on.  A rank directory over each bitmap (the ones before
every 4096th bit) finds an id's place on the next level, so any id can be read
alone, without decoding a block.

File, all little-endian:
  "DAC1", u32 levels, u64 documents, u64 ids
  i64 document ids, u8 id is null, u64 first id of each document and the end
  per level: u64 n, n chunk bytes, ceil(n / 8) bitmap bytes (low bit first),
  u64 ones before each 4096 bits
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexikv.llm.files import open_read, replace
from lexikv.llm.tokens import TokenIds
from lexikv.llm.words import slices
from lexikv.workspace import scratch, settle, small_batches

_MAGIC = b"DAC1"
_STRIDE = 4096


class DacWriter:
    """Collects ids; memory is about two bytes an id."""

    def __init__(self) -> None:
        self.chunks: list[list[np.ndarray]] = []
        self.goes_on: list[list[np.ndarray]] = []
        self.docs: list[int | None] = []
        self.starts = [0]

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        self.docs += docs
        self.starts += (self.starts[-1] + np.cumsum([len(x) // 4 for x in ids])).tolist()
        rest, level = np.frombuffer(b"".join(ids), "<u4"), 0
        while level == 0 or len(rest):
            if level == len(self.chunks):
                self.chunks.append([])
                self.goes_on.append([])
            more = rest > 255
            self.chunks[level].append((rest & 255).astype(np.uint8))
            self.goes_on[level].append(more)
            rest, level = rest[more] >> 8, level + 1

    def write(self, uri: str) -> None:
        with replace(uri) as out:
            out.write(_MAGIC + np.array([len(self.chunks)], "<u4").tobytes() + np.array([len(self.docs), self.starts[-1]], "<u8").tobytes())
            out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
            out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
            out.write(np.array(self.starts, "<u8").tobytes())
            for chunks, goes_on in zip(self.chunks, self.goes_on, strict=True):
                bits = np.concatenate(goes_on)
                out.write(np.array([len(bits)], "<u8").tobytes())
                for c in chunks:
                    out.write(c.tobytes())
                out.write(np.packbits(bits, bitorder="little").tobytes())
                out.write(_ranks(bits).tobytes())


def _ranks(bits: np.ndarray) -> np.ndarray:
    ones = np.add.reduceat(bits, np.arange(0, len(bits), _STRIDE), dtype=np.uint64) if len(bits) else np.empty(0, np.uint64)
    return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.empty(0, "<u8")


class DacReader:
    """Random access to a file's documents and ids."""

    def __init__(self, uri: str) -> None:
        self.file = open_read(uri)
        head = self._get(0, 24)
        if head[:4] != _MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        n_levels = int(np.frombuffer(head, "<u4", 1, 4)[0])
        self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(head, "<u8", 2, 8))
        at = 24
        self.docs = np.frombuffer(self._get(at, 8 * self.n_docs), "<i8")
        self.null = np.frombuffer(self._get(at + 8 * self.n_docs, self.n_docs), np.uint8).astype(bool)
        at += 9 * self.n_docs
        self.starts = np.frombuffer(self._get(at, 8 * self.n_docs + 8), "<u8").astype(np.int64)
        at += 8 * self.n_docs + 8
        self.levels = []  # positions of (chunks, bitmap, ranks)
        for _ in range(n_levels):
            n = int(np.frombuffer(self._get(at, 8), "<u8")[0])
            self.levels.append((at + 8, at + 8 + n, at + 8 + n + -(-n // 8)))
            at += 8 + n + -(-n // 8) + 8 * -(-n // _STRIDE)

    def __enter__(self) -> DacReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _get(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the token file is cut off")
        return data

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        first = a // 8
        data = np.frombuffer(self._get(self.levels[level][1] + first, -(-b // 8) - first), np.uint8)
        return np.unpackbits(data, bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        block = i // _STRIDE
        if not i % _STRIDE and i:
            block -= 1  # an end at a border has no entry of its own
        before = int(np.frombuffer(self._get(self.levels[level][2] + 8 * block, 8), "<u8")[0])
        return before + int(self._bits(level, block * _STRIDE, i).sum())

    def read(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b - 1 (of the level)."""
        if a >= b:
            return np.empty(0, np.uint32)
        out = np.frombuffer(self._get(self.levels[level][0] + a, b - a), np.uint8).astype(np.uint32)
        more = self._bits(level, a, b)
        if more.any():
            low = self._rank(level, a)
            out[more] |= self.read(low, low + int(more.sum()), level + 1) << np.uint32(8)
        return out

    def token(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, file_bytes: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each document's ids and ``end_id`` in ascending id order, null ids first.

    Returns a row for each file: part (in order), path, n_docs, n_ids, first_id
    (the ids in the files before it).  A null text is empty.  Documents that
    repeat an id are ordered by a hash of their text, and any number of them
    spreads over files.  ``file_bytes`` is the text that a file takes; unless
    given it grows with the corpus from 16 to 256 MB.  A very long text is
    encoded in parts and stays in one file.  An empty table makes no file.
    Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(8)), F.lit(0))).first()[0]
    file_bytes = file_bytes or min(256 << 20, max(16 << 20, n_bytes >> 12))
    folder = scratch(df.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encoder = TaskContext.get().partitionId(), DacWriter(), TokenIds.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", 1 << 20):
            writer.add(batch.column("doc_id").to_pylist(), [x + end for x in encoder.ids(batch.column("text").to_pylist())])
        encoder.rest()
        if writer.docs:
            path = f"{folder}/part-{part:06d}.dac"
            writer.write(path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]})

    # the number parts equal rows, which come in any order
    order = ["doc_id", "_h", "_n"]
    numbered = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(max(1, n_bytes // file_bytes), *order).sortWithinPartitions(*order).drop("_h", "_n")
    files = settle(ordered.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row for each file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, read back from them."""
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                with DacReader(path) as dac:
                    k = 0
                    while k < dac.n_docs:  # about a million ids at once
                        stop = max(k + 1, int(np.searchsorted(dac.starts, dac.starts[k] + (1 << 20), "right")) - 1)
                        at = dac.starts[k : stop + 1]
                        data = memoryview(dac.read(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                        cuts = (4 * (at - at[0])).tolist()
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(dac.docs[k:stop], mask=dac.null[k:stop]), "start": at[:-1] + first, "n_tokens": np.diff(at),
                            "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                        })
                        k = stop

    return files.select("path", "first_id").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
