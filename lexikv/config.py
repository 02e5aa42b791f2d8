"""Engine settings and the reader of their ``key = value`` text."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields

# Limits and defaults of the data format.
HARD_MIN_SIZE = 32
HARD_MAX_SIZE = 256 * 1024
MIN_DICT_BYTES = 1024


class ConfigError(ValueError):
    """A line with an unknown key or a value that can't be read."""


@dataclass(frozen=True)
class Config:
    enable_comp: bool = True
    enable_dict: bool = True
    dict_dir: str | None = None
    dict_size: int = 256 * 1024
    comp_level: int = 3
    min_comp_size: int = 32
    max_comp_size: int = 100 * 1024
    compress_keys: bool = False
    enable_training: bool = True
    retraining_interval: int = 2 * 60 * 60
    min_training_size: int = 0
    ewma_alpha: float = 0.05
    retrain_drop: float = 0.1
    train_mode: str = "FAST"
    training_window_duration: int = 0
    gc_cool_period: int = 3600
    gc_quarantine_period: int = 7 * 24 * 3600
    dict_retain_max: int = 10
    enable_sampling: bool = True
    sample_p: float = 0.02
    sample_window_duration: int = 0
    spool_dir: str | None = None
    spool_max_bytes: int = 64 * 1024 * 1024
    enable_async_cmd: bool = False
    async_thread_pool_size: int = 4
    async_queue_size: int = 32
    enable_string_filter: bool = False
    enable_hash_filter: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.comp_level <= 22:
            raise ConfigError(f"comp_level {self.comp_level} isn't in 1..22")
        if self.max_comp_size > HARD_MAX_SIZE:
            raise ConfigError(f"max_comp_size {self.max_comp_size} is over {HARD_MAX_SIZE}")
        if self.min_size > self.max_comp_size:
            raise ConfigError("min_comp_size is over max_comp_size")

    @property
    def min_size(self) -> int:
        """The least size that is compressed."""
        return max(self.min_comp_size, HARD_MIN_SIZE)

    def entries(self) -> dict[str, object]:
        return asdict(self)


_UNITS = {"": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3}
_SECONDS = {"": 1, "s": 1, "m": 60, "h": 3600}
_SIZE = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*")


def _scaled(text: str, scale: dict[str, int], what: str) -> int:
    found = _SIZE.fullmatch(text)
    unit = found and scale.get(found[2].lower())
    if unit is None:
        raise ConfigError(f"{text!r} isn't a {what}")
    return int(float(found[1]) * unit)


def parse_bytes(text: str) -> int:
    """``64MB``: k, m, g with an optional b or ib, all powers of 1024; fractions are cut."""
    return _scaled(text, {u: 1024**n for u, n in _UNITS.items()}, "size")


def parse_duration(text: str) -> int:
    """Seconds of ``90``, ``90s``, ``1.5m`` or ``2h``."""
    return _scaled(text, _SECONDS, "duration")


def parse_bool(text: str) -> bool:
    word = text.strip().lower()
    if word in ("true", "yes", "on", "1"):
        return True
    if word in ("false", "no", "off", "0"):
        return False
    raise ConfigError(f"{text!r} isn't true or false")


def parse_fraction(text: str) -> float:
    try:
        x = float(text)
    except ValueError as e:
        raise ConfigError(f"{text!r} isn't a number") from e
    if not 0 <= x <= 1:
        raise ConfigError(f"{text!r} isn't in 0..1")
    return x


def parse_train_mode(text: str) -> str:
    mode = text.strip().upper()
    if mode not in ("FAST", "OPTIMIZE"):
        raise ConfigError(f"{text!r} isn't FAST or OPTIMIZE")
    return mode


def _int(text: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise ConfigError(f"{text!r} isn't an integer") from e


_BYTES = {"dict_size", "min_comp_size", "max_comp_size", "min_training_size", "spool_max_bytes"}
_DURATIONS = {"retraining_interval", "gc_cool_period", "gc_quarantine_period", "sample_window_duration", "training_window_duration"}


def _reader(name: str, kind: str):  # noqa: ANN202
    if name in _BYTES:
        return parse_bytes
    if name in _DURATIONS:
        return parse_duration
    if name == "train_mode":
        return parse_train_mode
    return {"bool": parse_bool, "float": parse_fraction, "int": _int}.get(kind, str)


_READERS = {f.name: _reader(f.name, str(f.type)) for f in fields(Config)}


def parse_config(text: str) -> Config:
    """Lines of ``key = value``; ``#`` starts a comment, keys in any case, the last of equal keys counts."""
    found: dict[str, object] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        key, given, value = line.partition("=")
        key, value = key.strip().lower(), value.strip()
        if not given or key not in _READERS:
            raise ConfigError(f"line {number}: {key!r} isn't a setting")
        try:
            found[key] = _READERS[key](value)
        except ConfigError as e:
            raise ConfigError(f"line {number}: {key}: {e}") from e
    return Config(**found)
