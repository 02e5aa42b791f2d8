"""Counters by namespace, with the grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.operators import codec

GLOBAL = "global"


def write_counters(df: DataFrame, ns: str = "ns", raw_size: str = "raw_size", encoded: str = "encoded") -> DataFrame:
    """One row for each namespace and ``global`` from rows of ``Codec.encode`` structs.

    bytes_raw_total has all writes, bytes_cmp_total only those that were
    encoded.  Writes with compression disabled aren't counted.
    """
    rows = df.select(F.col(ns).alias("ns"), F.col(raw_size).alias("raw"), F.col(f"{encoded}.outcome").alias("outcome"), F.col(f"{encoded}.clen").alias("clen")).filter(F.col("outcome") != codec.DISABLED)
    one = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0))
    out = rows.rollup("ns").agg(
        F.grouping("ns").alias("_all"), F.count("*").alias("writes_total"), F.coalesce(F.sum("raw"), F.lit(0)).cast("long").alias("bytes_raw_total"),
        F.coalesce(F.sum(F.when(F.col("outcome") == codec.ENCODED, F.col("clen"))), F.lit(0)).alias("bytes_cmp_total"),
        one(codec.SKIP_MIN).alias("skipped_min"), one(codec.SKIP_MAX).alias("skipped_max"), one(codec.SKIP_INCOMPRESSIBLE).alias("skipped_incomp"),
        F.coalesce(F.sum(F.when(F.col("outcome") == codec.ENCODED, F.col("raw"))), F.lit(0)).cast("long").alias("bytes_encoded_total"),
    )
    return out.withColumn("ns", F.when(F.col("_all") == 1, GLOBAL).otherwise(F.col("ns"))).drop("_all")


def read_counters(df: DataFrame, ns: str = "ns", decoded: str = "decoded") -> DataFrame:
    """Reads that reached the decoder, and their errors, by namespace and in all."""
    rows = df.select(F.col(ns).alias("ns"), F.col(f"{decoded}.status").alias("status")).filter(F.col("status") != codec.RAW)
    one = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    out = rows.rollup("ns").agg(F.grouping("ns").alias("_all"), F.count("*").alias("reads_total"), one(codec.CORRUPT).alias("decompress_errs"), one(codec.DICT_MISS).alias("dict_miss_errs"))
    return out.withColumn("ns", F.when(F.col("_all") == 1, GLOBAL).otherwise(F.col("ns"))).drop("_all")


def training_counters(runs: DataFrame) -> DataFrame:
    """Retraining by namespace and in all, from rows (ns, seq, trigger, failed, ms).

    ``trigger``: rise, drop or null; ``trainer_ms_last`` is that of the run of
    greatest seq.  Null ``failed`` counts as false.
    """
    out = runs.select("ns", "seq", "trigger", "failed", "ms").rollup("ns").agg(
        F.grouping("ns").alias("_all"), F.count_if(F.col("trigger") == "rise").alias("triggers_rise"), F.count_if(F.col("trigger") == "drop").alias("triggers_drop"),
        F.count_if(F.col("failed")).alias("trainer_errs"), F.max_by("ms", "seq").cast("long").alias("trainer_ms_last"),
    )
    return out.withColumn("ns", F.when(F.col("_all") == 1, GLOBAL).otherwise(F.col("ns"))).drop("_all")


def ratio(raw: Column, compressed: Column) -> Column:
    """raw / compressed; 0 where nothing was compressed."""
    return F.coalesce(raw / F.when(compressed != 0, compressed), F.lit(0.0))


#: Counters that a snapshot shows and nothing feeds: a frame that can't be made fails its task instead of being counted.
UNFED = ["compress_errs", "retrain", "last_retrain_ms", "trainer_runs", "shadow_pct", "shadow_samples", "shadow_raw", "shadow_saved", "promotions", "rollbacks", "cooldown_left"]


#: Counters of training, 0 without a record of runs or a sample.
TRAINING = ["triggers_rise", "triggers_drop", "trainer_errs", "trainer_ms_last"]
RESERVOIR = ["reservoir_items", "reservoir_bytes"]


def snapshot(
    writes: DataFrame, reads: DataFrame, active: DataFrame, tracker: DataFrame, training: DataFrame | None = None, reservoir: DataFrame | None = None, config: Config = Config()
) -> DataFrame:
    """Counters of each namespace joined with its active dictionary and, for ``default`` and ``global``, the tracker.

    ``active``: ns, dict_id, dict_size, total_dicts; ``tracker``: one row of
    ``efficiency.track`` or none; ``training``: ``training_counters``;
    ``reservoir``: one row of ``sampling.warm_up``, also for these two.  All are
    small: one row a namespace.
    """
    ours = F.col("ns").isin("default", GLOBAL)
    out = writes.join(reads, "ns", "full").join(active, "ns", "left").join(F.broadcast(tracker.select("ewma", "baseline").limit(1)), ours, "left")
    out = out.join(training, "ns", "left") if training is not None else out.withColumns({c: F.lit(0).cast("long") for c in TRAINING})
    if reservoir is not None:
        held = reservoir.select(F.col("k").alias("reservoir_items"), F.col("bytes").cast("long").alias("reservoir_bytes")).limit(1)
        out = out.join(F.broadcast(held), ours, "left")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in RESERVOIR})
    out = out.withColumn("train_mode", F.lit(config.train_mode))
    zero = [c for c in out.columns if c not in ("ns", "ewma", "baseline", "train_mode")]
    out = out.fillna(0, zero).fillna(0.0, ["ewma", "baseline"])
    return out.withColumns({"comp_ratio": ratio(F.col("bytes_raw_total"), F.col("bytes_cmp_total")), "true_ratio": ratio(F.col("bytes_encoded_total"), F.col("bytes_cmp_total"))} | {c: F.lit(0).cast("long") for c in UNFED})


def namespaces(registry: DataFrame) -> DataFrame:
    """``global``, every namespace of the registry, ``default``; each once."""
    names = registry.select(F.explode("namespaces").alias("ns")).filter(F.col("ns") != "default").distinct()
    spark = registry.sparkSession
    return spark.createDataFrame([("global",)], "ns string").unionAll(names).unionAll(spark.createDataFrame([("default",)], "ns string"))
