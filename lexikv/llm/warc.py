"""WARC 1.1 archives of pages: writing with revisit records, and a sequential reader.

Each record is a gzip member of its own.  The reader inflates a file piece by
piece, frames records by Content-Length and checks payload digests; it holds
one record and one piece at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikv.llm.files import open_read, replace
from lexikv.llm.words import slices
from lexikv.workspace import scratch, settle, small_batches

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 16


class WarcError(ValueError):
    """An archive that is cut off, misframed or altered."""


class Record(NamedTuple):
    headers: dict[str, str]  #: names in lower case
    block: bytes


def _inflated(source: pa.NativeFile) -> Iterator[bytes | None]:
    """The pieces of each gzip member; None after each member."""
    member, data = None, b""
    while data or (data := source.read(_PIECE)):
        member = member or zlib.decompressobj(31)
        try:
            piece = member.decompress(data, 1 << 20)
        except zlib.error as e:
            raise WarcError(f"bad gzip member: {e}") from e
        if piece:
            yield piece
        data = member.unconsumed_tail
        if member.eof:
            data, member = member.unused_data, None
            yield None
    if member is not None:
        raise WarcError("the last record is cut off")


def read_records(source: pa.NativeFile) -> Iterator[Record]:
    """All records in order, each from its own gzip member."""
    held: list[bytes] = []
    for piece in _inflated(source):
        if piece is not None:
            held.append(piece)
            continue
        data, held = b"".join(held), []
        head, gap, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not gap or not version.startswith("WARC/"):
            raise WarcError("a record without a WARC header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise WarcError(f"{headers.get('warc-record-id')}: the block isn't {length} bytes")
        yield Record(headers, rest[:length])


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def digest_header(payload_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(payload_sha1)).decode()


def _uri(url: str | None) -> str:
    """Without what would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _member(lines: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def info(archive: str) -> bytes:
    """The record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    return _member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_urn(archive, 0)}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"], block)


def _urn(archive: str, number: int) -> str:
    """An id that no other record has, the same in each attempt at a task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None = None, revisit: bool = False, urn: str = "<urn:uuid:00000000-0000-0000-0000-000000000000>") -> bytes:
    """One record, compressed; a revisit keeps the HTTP headers alone.  Pages are named by headers of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn}", f"Page-ID: {'' if page_id is None else page_id}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {digest_header(sha1)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return _member(lines, block)


def write_archives(df: DataFrame, min_revisit: int = 1000, archive_bytes: int = 1 << 30, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row; returns path, n_records, n_bytes of each archive.

    A task begins a new archive when one has ``archive_bytes``.

    Of equal payloads of at least ``min_revisit`` bytes the one with the
    largest id is a response and the others revisit it; rows that repeat that
    id and payload are all responses.  Where no such row has an id, all are
    responses.  A null payload is empty; one of any length is a record, which a
    task holds whole.  An empty table makes no archive.  Other columns are
    ignored.
    """
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).alias("n"))
    held = rows.filter(F.col("n") >= min_revisit).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("sha1", "first")
    # small payloads have no part in this and keep out of each other's way
    key = F.when(F.col("n") >= min_revisit, F.col("sha1")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    chosen = rows.withColumn("_key", key).join(held.withColumnRenamed("sha1", "_key"), "_key", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    folder = scratch(df.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in slices(batches, "html", 1 << 22) for r in batch.to_pylist())
        part, archive = TaskContext.get().partitionId(), 0
        r = next(rows, None)
        while r is not None:
            name, n, size = f"part-{part:06d}-{archive:04d}.warc.gz", 0, 0
            with replace(f"{folder}/{name}") as out:
                out.write(info(name))
                while r is not None and size < archive_bytes:
                    data = record(r["page_id"], r["url"], r["html"].encode(), r["sha1"], r["first"], r["revisit"], _urn(name, n + 1))
                    out.write(data)
                    n, size, r = n + 1, size + len(data), next(rows, None)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})
            archive += 1

    return settle(chosen.select("page_id", "url", "html", "sha1", "first", "revisit").mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-files")


def _page(value: str | None) -> int | None:
    return int(value) if value else None


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    ``with_payload`` adds the payload (null for a revisit).  Raises WarcError
    where a response's payload doesn't match its digest.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def rows(path: str) -> Iterator[dict]:
        with open_read(path) as source:
            for headers, block in read_records(source):
                if headers["warc-type"] == "warcinfo":
                    continue
                http, body = split_http(block)
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = headers["warc-type"]
                if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(http["content-length"])):  # noqa: S324
                    raise WarcError(f"{path}: {headers['warc-record-id']} has another payload than its digest")
                yield {
                    "page_id": _page(headers.get("page-id")), "url": headers["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                    "record_type": kind, "refers_to": _page(headers.get("refers-to-page-id")), "payload": body if kind == "response" else None,
                }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row if with_payload else row | {"payload": None})
                    size += 200 + row["payload_bytes"] * with_payload
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    sql = {"int64": "long", "string": "string", "binary": "binary"}
    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(read, ", ".join(f"{n} {sql[str(t)]}" for n, t in fields))
