"""The stored form of a value, read by built-in expressions.

An encoded value is a big-endian 16-bit dictionary id and a Zstandard frame
whose header tells the content size; all else is raw.  Nothing here decodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zstandard frame magic numbers (RFC 8878), as hex.
_MAGIC = "28B52FFD"
_SKIPPABLE = "2A4D18"


def _parts(stored: Column) -> dict[str, Column]:
    # the longest header takes 2 (id) + 4 + 1 + 1 + 4 + 8 bytes
    head = F.hex(F.substring(stored, 1, 20))
    size = F.octet_length(stored) - 2
    byte = lambda i: F.conv(F.nullif(F.substring(head, 2 * i - 1, 2), F.lit("")), 16, 10).cast("int")
    descriptor = byte(7)
    flag, single, dictionary = F.shiftright(descriptor, 6), F.shiftright(descriptor, 5).bitwiseAND(F.lit(1)), descriptor.bitwiseAND(F.lit(3))
    id_width = F.when(dictionary == 3, 4).otherwise(dictionary)
    width = F.when(flag == 0, single).when(flag == 1, 2).when(flag == 2, 4).otherwise(8)
    at = 8 + (1 - single) + id_width  # of the content size, in the stored value, from 1
    window_ok = (single == 1) | (F.shiftright(byte(8), 3) + 10 <= 31)
    frame = (F.substring(head, 5, 8) == _MAGIC) & (size >= 5) & (size >= at - 3 + width) & (descriptor.bitwiseAND(F.lit(8)) == 0) & window_ok & (width > 0)
    # little-endian: swap the digits of each byte, then turn all around
    digits = F.substring(head, (2 * at - 1).cast("int"), (2 * width).cast("int"))
    content = F.conv(F.reverse(F.regexp_replace(digits, "(.)(.)", "$2$1")), 16, 10).try_cast("long") + F.when(flag == 1, 256).otherwise(0)
    skippable = (F.substring(head, 5, 1) == "5") & (F.substring(head, 7, 6) == _SKIPPABLE) & (size >= 8)
    return {"frame": F.coalesce(frame, F.lit(False)), "skippable": F.coalesce(skippable, F.lit(False)), "content": content}


def is_encoded(stored: Column) -> Column:
    """Whether the value counts as encoded; null for null."""
    p = _parts(stored)
    return F.when(stored.isNotNull(), p["frame"] | p["skippable"])


def dict_id(stored: Column) -> Column:
    """The dictionary id of an encoded value, else null."""
    return F.when(is_encoded(stored), F.conv(F.hex(F.substring(stored, 1, 2)), 16, 10).cast("int"))


def logical_length(stored: Column) -> Column:
    """Bytes of the value that is stored, from the header alone."""
    p = _parts(stored)
    return F.when(p["skippable"], F.lit(0)).when(p["frame"], p["content"]).otherwise(F.octet_length(stored)).cast("long")


def stored_length(stored: Column) -> Column:
    return F.octet_length(stored).cast("long")


def id_bytes(id: Column) -> Column:
    """The two bytes in front of a frame."""
    return F.unhex(F.lpad(F.hex(id), 4, "0"))


def split_stored(stored: Column) -> Column:
    """struct(is_encoded, dict_id, payload, logical_len)."""
    encoded = is_encoded(stored)
    payload = F.when(encoded, F.substring(stored, F.lit(3), F.octet_length(stored))).otherwise(stored)
    return F.struct(encoded.alias("is_encoded"), dict_id(stored).alias("dict_id"), payload.alias("payload"), logical_length(stored).alias("logical_len"))
