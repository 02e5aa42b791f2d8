"""Shared scratch space for results that several Spark jobs read.

Tables and files go below ``spark.checkpoint.dir``, which every executor of a
cluster can reach.  Only a single-JVM session (``local[...]``) that names no
such directory gets one of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The directory that driver and executors share.

    Raises ValueError on a cluster that names none, as a folder of the
    driver's own machine would be invisible to its executors.
    """
    found = spark.conf.get(_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {_KEY} to a directory that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexikv-")
        spark.conf.set(_KEY, found)
        _made.append((spark, found))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared directory; nothing exists there yet."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def small_batches(spark: SparkSession, rows: int = 4000, mb: int = 8) -> None:
    """Let Arrow batches hold few rows and bytes, for functions over whole texts.

    Holds for the session's later queries; smaller settings stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: each query's are deleted at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before)


_CHECKS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch space and read it back.

    Cuts the lineage: whatever reads the result survives the loss of any
    executor without computing ``df`` again.  The size of pages and row groups
    is looked at from the first row on, not the hundredth: pages of up to a
    hundred large values would need buffers of their size, which executors keep
    outside the heap.
    """
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.options(**_CHECKS).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch paths that this session made: these, or all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for owner, path in list(_made):
        if owner is spark and (paths is None or path in paths):
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
            _made.remove((owner, path))


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch paths made inside are deleted at the end, but for the last: the result, which must not read the others any more."""
    shared_dir(spark)  # made before, as it stays
    before = len(_made)
    yield
    discard(spark, [path for owner, path in _made[before:] if owner is spark and path != _made[-1][1]])


@atexit.register
def _discard_all() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        with contextlib.suppress(Exception):  # the session may be stopped by now
            discard(spark)
