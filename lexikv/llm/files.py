"""Files in the shared folder, opened from tasks by URI (local, HDFS, S3, ...)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs


def open_read(uri: str) -> pa.NativeFile:
    """Random access."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


@contextlib.contextmanager
def replace(uri: str) -> Iterator[pa.NativeFile]:
    """Write a file that appears under its name only when whole.

    A second attempt at a task replaces what the first one wrote.
    """
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with system.open_output_stream(own) as out:
            yield out
        system.move(own, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(own)
        raise
