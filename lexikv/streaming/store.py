"""The key-value store over a stream of commands.

State is one value for each key, kept by ``transformWithStateInPandas`` (the
RocksDB state store); expiry is a processing-time timer.  Counters and the
efficiency tracker are streaming aggregates and a driver-side fold of small
per-batch results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

LOG_SCHEMA = "seq long, ts timestamp, cmd string, key string, value string, ttl long"
REPLY = StructType([StructField("key", StringType()), StructField("seq", LongType()), StructField("reply", StringType())])
_VALUE = StructType([StructField("value", StringType()), StructField("expire_ms", LongType())])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def apply_command(cmd: str, held: str | None, value: str | None) -> tuple[str | None, str | None]:
    """(new value, reply) of one string command on a key that holds ``held``."""
    if cmd in ("set", "setex", "psetex"):
        return value, "OK"
    if cmd == "setnx":
        return (held, "0") if held is not None else (value, "1")
    if cmd == "getset":
        return value, held
    if cmd == "append":
        new = (held or "") + (value or "")
        return new, str(len(new.encode()))
    if cmd == "getdel":
        return None, held
    if cmd == "del":
        return None, str(int(held is not None))
    if cmd == "strlen":
        return held, str(len((held or "").encode()))
    return held, held  # get, getex


class StringStore(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", _VALUE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, expire = self.state.get() if self.state.exists() else (None, None)
        replies = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = int(pd.Timestamp(r.ts).timestamp() * 1000)
            if expire is not None and expire <= now:
                held = expire = None
            ttl = None if r.ttl is None or pd.isna(r.ttl) else int(r.ttl)
            held, reply = apply_command(r.cmd, held, r.value)
            if r.cmd in ("set", "setex", "psetex", "getset", "getex"):
                expire = None if ttl is None else now + ttl * (1 if r.cmd == "psetex" else 1000)
            if held is None:
                expire = None
            replies.append((key[0], int(r.seq), reply))
        if held is None:
            self.state.clear()
        else:
            self.state.update((held, expire))
            if expire is not None:
                self.handle.registerTimer(max(expire, timerValues.getCurrentProcessingTimeInMs() + 1))
        yield pd.DataFrame(replies, columns=["key", "seq", "reply"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.state.exists():
            expire = self.state.get()[1]
            if expire is not None and expire <= timerValues.getCurrentProcessingTimeInMs():
                self.state.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "seq": pd.Series(dtype="int64"), "reply": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def replies(commands: DataFrame) -> DataFrame:
    """The reply to each command of a streaming log (``LOG_SCHEMA``); commands of a key are applied in order of seq within a batch."""
    return commands.groupBy("key").transformWithStateInPandas(statefulProcessor=StringStore(), outputStructType=REPLY, outputMode="Append", timeMode="ProcessingTime")


def counters(commands: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Writes, reads and bytes by command and event-time window; late rows beyond the watermark are dropped."""
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    late = commands.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", window), "cmd").agg(F.count("*").alias("commands"), F.sum(size).alias("bytes")).select(F.col("window.start").alias("start"), "cmd", "commands", "bytes")


class Tracker:
    """The efficiency tracker for ``foreachBatch``: folds each batch's ratios, and calls ``retrain`` when due.

    Takes rows (seq, ts, raw, cmp).  Batches are folded by Spark; only the
    fold, one row, reaches the driver.  A batch that is replayed after a
    failure is recognised by its number and counted once.
    """

    def __init__(self, alpha: float, interval: int, min_bytes: int, drop: float, retrain: Callable[[DataFrame], bool]) -> None:
        self.alpha, self.interval, self.min_bytes, self.drop, self.retrain = alpha, interval, min_bytes, drop, retrain
        self.ewma = self.baseline = self.since = None
        self.bytes = self.rises = self.drops = 0
        self.last_batch = -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        from lexikv.operators.efficiency import track

        if number <= self.last_batch:
            return
        found, end = track(batch, self.alpha).first(), batch.agg(F.max("ts")).first()[0]
        self.last_batch = number
        if found is None:
            return
        if self.ewma is None:
            self.ewma, self.baseline, self.since = found["ewma"], found["baseline"], end
        else:
            # the batch's fold seeds itself with its first ratio; here that ratio is one more step
            n = found["observations"]
            self.ewma = found["ewma"] + (1 - self.alpha) ** n * (self.ewma - found["baseline"])
        self.bytes += found["bytes"]
        moved = not self.baseline or abs(self.ewma / self.baseline - 1) >= self.drop
        if end - self.since >= dt.timedelta(seconds=self.interval) and self.bytes >= self.min_bytes and moved:
            self.rises += self.ewma < self.baseline
            self.drops += self.ewma > self.baseline
            if self.retrain(batch):
                self.baseline, self.since, self.bytes = min(self.baseline, self.ewma), end, 0
