"""Train a dictionary from a bounded sample of values."""

from __future__ import annotations

import datetime as dt
import uuid

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikv.config import MIN_DICT_BYTES, Config
from lexikv.operators.registry import SCHEMA
from lexikv.operators.sampling import reservoir

#: Sample values that training may bring to the driver, in bytes; a setting that asks for more is refused.
MAX_SAMPLE_BYTES = 256 << 20


class TrainingError(ValueError):
    """The sample is too small or too uniform for a dictionary."""


def budget(config: Config) -> int:
    """Bytes of samples that a training uses."""
    wanted = config.min_training_size or 100 * config.dict_size
    if wanted > MAX_SAMPLE_BYTES:
        raise TrainingError(f"a training of {wanted} bytes is asked for; at most {MAX_SAMPLE_BYTES} are sampled")
    return wanted


def train(df: DataFrame, config: Config, value: str = "value", seq: str = "seq", seed: int = 0) -> bytes:
    """A dictionary from a uniform sample of at most ``budget(config)`` bytes."""
    limit = budget(config)
    sizes = df.filter(F.octet_length(value).between(1, limit)).select(F.col(seq).alias("seq"), F.col(value).cast("binary").alias("value"))
    mean = sizes.agg(F.avg(F.octet_length("value"))).first()[0]
    if not mean:
        raise TrainingError("no values to train on")
    samples, size = [], 0
    for row in reservoir(sizes, max(1, int(limit / mean)), seed).toLocalIterator():
        size += len(row["value"])
        if size > limit:
            break
        samples.append(bytes(row["value"]))
    try:
        made = zstandard.train_dictionary(config.dict_size, samples, **({"level": config.comp_level, "steps": 16, "threads": 1} if config.train_mode == "OPTIMIZE" else {})).as_bytes()
    except zstandard.ZstdError as e:
        raise TrainingError(str(e)) from e
    if len(made) < MIN_DICT_BYTES:
        raise TrainingError(f"the dictionary has {len(made)} bytes; at least {MIN_DICT_BYTES} are wanted")
    return made


def registry_row(like: DataFrame, dictionary: bytes, namespaces: list[str], level: int, created: dt.datetime | None = None) -> DataFrame:
    """A registry row for a new dictionary, whose id ``registry.publish`` gives."""
    row = (None, str(uuid.uuid4()), dictionary, namespaces, created or dt.datetime.now(dt.UTC), None, level, None, len(dictionary))
    return like.sparkSession.createDataFrame([row], SCHEMA)
