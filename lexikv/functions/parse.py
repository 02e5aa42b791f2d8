"""Column forms of the settings' value parsers, and small text helpers.

A value that can't be read gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexikv.config import _SECONDS, _UNITS

_PATTERN = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def _scaled(text: Column, scale: dict[str, int]) -> Column:
    number, unit = F.regexp_extract(text, _PATTERN, 1), F.lower(F.regexp_extract(text, _PATTERN, 2))
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in scale.items() for x in pair)), unit)
    return F.when(number != "", F.floor(number.try_cast("double") * factor)).cast("long")


def bytes_of(text: Column) -> Column:
    return _scaled(text, {u: 1024**n for u, n in _UNITS.items()})


def seconds_of(text: Column) -> Column:
    return _scaled(text, _SECONDS)


def boolean_of(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "on", "1"), True).when(word.isin("false", "no", "off", "0"), False)


def fraction_of(text: Column) -> Column:
    x = F.trim(text).try_cast("double")
    return F.when(x.between(0.0, 1.0), x)


def train_mode_of(text: Column) -> Column:
    mode = F.upper(F.trim(text))
    return F.when(mode.isin("FAST", "OPTIMIZE"), mode)


def split_names(text: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def join_names(names: Column) -> Column:
    return F.array_join(names, ",")


def time_of(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` as a timestamp of a UTC session."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")
