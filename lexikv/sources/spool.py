"""Sample spool files: records of u32 key length, u32 value length, key, value (little-endian).

``spark.read.format("kvspool").load(path)`` reads files or directories of them
as (key, value); ``df.write.format("kvspool").save(path)`` writes one file for
each task.  Register the format with ``register(spark)``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

_HEAD = struct.Struct("<II")
_BATCH_BYTES = 4 << 20
SCHEMA = StructType([StructField("key", BinaryType()), StructField("value", BinaryType())])


def pack_record(key: bytes, value: bytes) -> bytes:
    return _HEAD.pack(len(key), len(value)) + key + value


def read_records(source: pa.NativeFile) -> Iterator[tuple[bytes, bytes]]:
    """The records of a file; one that its end cuts off is left out, as the writer was stopped there."""
    while len(head := source.read(_HEAD.size)) == _HEAD.size:
        k, v = _HEAD.unpack(head)
        body = source.read(k + v)
        if len(body) < k + v:
            return
        yield body[:k], body[k:]


@dataclass
class _File(InputPartition):
    uri: str


@dataclass
class _Written(WriterCommitMessage):
    uri: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [_File(self.path)]
        found = system.get_file_info(fs.FileSelector(path))
        return [_File(f"{self.path.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".bin")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(partition.uri)
        with system.open_input_stream(path) as source:
            keys, values, size = [], [], 0
            for k, v in read_records(source):
                keys.append(k)
                values.append(v)
                size += len(k) + len(v) + 16
                if size >= _BATCH_BYTES:
                    yield _batch(keys, values)
                    keys, values, size = [], [], 0
            if keys:
                yield _batch(keys, values)


def _batch(keys: list[bytes], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["key", "value"])


def _packed(batch: pa.RecordBatch) -> bytes:
    keys, values = batch.column("key"), batch.column("value")
    if keys.null_count or values.null_count:
        raise ValueError("a spool record has a key and a value; null can't be written")
    return b"".join(pack_record(k, v) for k, v in zip(keys.to_pylist(), values.to_pylist(), strict=True))


class _Writer(DataSourceArrowWriter):
    """Tasks write under names of their own; the commit gives the files their ending."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        name = f"samples-{uuid.uuid4().hex}.part"
        with system.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                out.write(_packed(batch))
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/{m.uri}", f"{path}/{m.uri.removesuffix('.part')}.bin")

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.uri}")


class SpoolSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvspool"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SpoolSource)
