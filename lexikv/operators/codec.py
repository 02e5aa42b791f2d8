"""Encode and decode values with Zstandard and a dictionary per namespace.

Sizes and headers are judged by built-in expressions; only values that need
the compressor reach the Arrow function, all others are sent as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.functions.header import dict_id as stored_dict_id
from lexikv.functions.header import id_bytes, is_encoded
from lexikv.workspace import give_back, small_batches

#: Larger values are refused before they are inflated, whatever a frame's header claims.
MAX_VALUE_BYTES = 512 << 20
#: All dictionaries together are broadcast; beyond this size a registry is refused.
MAX_DICTIONARY_BYTES = 256 << 20

ENCODED, DISABLED, SKIP_MIN, SKIP_MAX, SKIP_INCOMPRESSIBLE = "encoded", "disabled", "skip_min", "skip_max", "skip_incomp"
OK, RAW, DICT_MISS, CORRUPT = "ok", "raw", "dict_miss", "corrupt"


class Codec:
    """Column expressions over a fixed set of dictionaries (id -> bytes).

    Lowers the session's Arrow batches to 1,000 rows and 2 MB: a Python worker
    holds a batch as Arrow, pandas and frames at once.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), dictionaries: dict[int, bytes] | None = None) -> None:
        held = dictionaries or {}
        if any(not 1 <= i <= 65535 for i in held):
            raise ValueError("dictionary ids are 1..65535")
        if sum(map(len, held.values())) > MAX_DICTIONARY_BYTES:
            raise ValueError(f"the dictionaries are over {MAX_DICTIONARY_BYTES} bytes")
        small_batches(spark, 1000, 2)
        self.config = config
        self._held = spark.sparkContext.broadcast(held)

    def encode(self, value: Column, dictionary: Column | int = 0) -> Column:
        """struct(stored, clen, dict_id, outcome) of a binary value; null for null.

        Values outside the size limits, and those that don't shrink, stay raw.
        An id without a dictionary counts as 0, no dictionary.
        """
        c, held = self.config, self._held
        level = c.comp_level

        @F.pandas_udf("struct<frame: binary, id: int>")
        def compress(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            made: dict[int, zstandard.ZstdCompressor] = {}
            for values, ids in parts:
                frames, used = [], []
                for v, i in zip(values, ids, strict=True):
                    if v is None:
                        frames.append(None)
                        used.append(0)
                        continue
                    i = int(i) if i in held.value else 0
                    if i not in made:
                        own = zstandard.ZstdCompressionDict(held.value[i]) if i else None
                        if own:
                            own.precompute_compress(level=level)
                        made[i] = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=False, write_dict_id=False, write_content_size=True)
                    frames.append(made[i].compress(v))
                    used.append(i)
                yield pd.DataFrame({"frame": frames, "id": pd.Series(used, dtype="int32")})
            give_back()

        length = F.octet_length(value)
        gate = length.between(c.min_size, c.max_comp_size) & F.lit(c.enable_comp)
        id = F.coalesce(F.lit(dictionary) if isinstance(dictionary, int) else dictionary, F.lit(0)) if c.enable_dict else F.lit(0)
        done = compress(F.when(gate, value), id.cast("int"))
        shorter = F.octet_length(done["frame"]) < length
        outcome = F.when(F.lit(not c.enable_comp), DISABLED).when(length < c.min_size, SKIP_MIN).when(length > c.max_comp_size, SKIP_MAX).when(shorter, ENCODED).otherwise(SKIP_INCOMPRESSIBLE)
        stored = F.when(gate & shorter, F.concat(id_bytes(done["id"]), done["frame"])).otherwise(value)
        fields = F.struct(stored.alias("stored"), F.octet_length(done["frame"]).cast("long").alias("clen"), F.when(gate & shorter, done["id"]).alias("dict_id"), outcome.alias("outcome"))
        return F.when(value.isNotNull(), fields)

    def decode(self, stored: Column) -> Column:
        """struct(value, status): ok, raw, dict_miss or corrupt; null for null.

        A value that counts as encoded and can't be decoded, or whose header
        claims over ``MAX_VALUE_BYTES``, has a null value;
        what becomes of its key is up to the caller (``split_healed``).
        """
        held = self._held

        @F.pandas_udf("struct<value: binary, status: string>")
        def expand(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            made: dict[int, zstandard.ZstdDecompressor] = {}
            for values, ids in parts:
                out = []
                for v, i in zip(values, ids, strict=True):
                    if v is None:
                        out.append((None, RAW))
                        continue
                    i = int(i)
                    if i and i not in held.value:
                        out.append((None, DICT_MISS))
                        continue
                    if i not in made:
                        made[i] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held.value[i]) if i else None)
                    try:
                        fits = zstandard.frame_content_size(v[2:]) <= MAX_VALUE_BYTES
                        plain = made[i].decompress(v[2:]) if fits else b""
                        out.append((plain, OK) if plain else (None, CORRUPT))
                    except (zstandard.ZstdError, MemoryError):
                        out.append((None, CORRUPT))
                yield pd.DataFrame(out, columns=["value", "status"])
            give_back()

        encoded = is_encoded(stored)
        done = expand(F.when(encoded, stored), F.coalesce(stored_dict_id(stored), F.lit(0)))
        fields = F.struct(F.when(encoded, done["value"]).otherwise(stored).alias("value"), F.when(encoded, done["status"]).otherwise(F.lit(RAW)).alias("status"))
        return F.when(stored.isNotNull(), fields)


def split_healed(decoded: DataFrame, keys: list[str], struct: str = "decoded", replica: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that decode, keys to delete) of rows with a ``Codec.decode`` column.

    A replica deletes nothing.
    """
    bad = F.coalesce(F.col(f"{struct}.status").isin(DICT_MISS, CORRUPT), F.lit(False))
    clean = decoded.filter(~bad).select("*", F.col(f"{struct}.value").alias("value")).drop(struct)
    gone = decoded.filter(bad).select(*keys)
    return clean, gone.limit(0) if replica else gone


def append_raw(decoded: Column, chunk: Column) -> Column:
    """APPEND: the plain value with ``chunk`` behind it; it stays raw."""
    return F.concat(F.coalesce(decoded, F.lit(b"")), chunk)


def byte_range(value: Column, start: Column | int, end: Column | int) -> Column:
    """GETRANGE: bytes start..end, both included; negative ones count from the end; empty beyond it."""
    n = F.octet_length(value)
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    a, b = F.greatest(F.when(a < 0, n + a).otherwise(a), F.lit(0)), F.least(F.when(b < 0, n + b).otherwise(b), n - 1)
    return F.when(value.isNotNull(), F.when((b >= a) & (b >= 0), F.substring(value, (a + 1).cast("int"), (b - a + 1).cast("int"))).otherwise(F.lit(b"")))


def set_range(value: Column, offset: Column | int, patch: Column) -> Column:
    """SETRANGE: ``patch`` written over the value at ``offset``, zero bytes between; an empty patch changes nothing."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    held = F.coalesce(value, F.lit(b""))
    padded = F.when(F.octet_length(held) < at, F.rpad(held, at.cast("int") if not isinstance(offset, int) else offset, F.lit(b"\0"))).otherwise(held)
    n = F.octet_length(patch)
    joined = F.concat(F.substring(padded, F.lit(1), at.cast("int")), patch, F.substring(padded, (at + n + 1).cast("int"), F.octet_length(padded)))
    return F.when(n > 0, joined).otherwise(held)
