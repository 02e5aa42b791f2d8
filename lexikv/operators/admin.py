"""Frames for the administrative commands: stats, config, ns, role."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.operators.stats import GLOBAL


def config_frame(spark: SparkSession, config: Config) -> DataFrame:
    """(name, value), one row for each setting."""
    text = lambda v: "" if v is None else json.dumps(v) if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(k, text(v)) for k, v in config.entries().items()], "name string, value string")


def stats_of(snapshot: DataFrame, ns: str | None) -> DataFrame:
    """One namespace's row; the total for None.  Unknown names give no row."""
    return snapshot.filter(F.col("ns") == (ns or GLOBAL))


#: Entries of ``stats`` in their order (fixed values).
ENTRIES = [
    "ns", "ewma_m", "baseline", "comp_ratio", "bytes_raw_total", "bytes_cmp_total", "reads_total", "writes_total", "dict_id", "dict_size", "total_dicts",
    "train_mode", "retrain", "last_retrain_ms", "trainer_runs", "trainer_errs", "trainer_ms_last", "reservoir_bytes", "reservoir_items",
    "shadow_pct", "shadow_samples", "shadow_raw", "shadow_saved", "promotions", "rollbacks", "triggers_rise", "triggers_drop", "cooldown_left",
    "compress_errs", "decompress_errs", "dict_miss_errs", "skipped_min", "skipped_max", "skipped_incomp",
]
_FRACTIONS = {"ewma_m", "baseline", "comp_ratio"}


def stats_entries(snapshot: DataFrame) -> DataFrame:
    """(ns, pos, entry, value) of each namespace's entries, as text; fractions with six digits."""
    source = lambda e: F.col("ewma" if e == "ewma_m" else e)
    text = lambda e: F.format_string("%.6f", source(e).cast("double")) if e in _FRACTIONS else source(e).cast("string")
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(e).alias("entry"), text(e).alias("value")) for i, e in enumerate(ENTRIES, 1)))
    return snapshot.select("ns", F.inline(rows))


def as_json() -> Column:
    return F.to_json(F.struct("*"))


def role_frame(spark: SparkSession, role: str, flags: list[str]) -> DataFrame:
    return spark.createDataFrame([(role, ",".join(flags))], "role string, flags string")
