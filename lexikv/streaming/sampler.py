"""The spool sampler: start, stop and status of sampling a stream of writes into a spool."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikv.config import Config
from lexikv.operators.sampling import spool_records
from lexikv.sources import spool
from lexikv.workspace import scratch, settle


class Sampler:
    """Samples rows (seq, key, value) of a stream by a streaming query of its own.

    Each start writes to a new folder named by its time, below
    ``spool_dir`` or the scratch space, until ``spool_max_bytes`` are written
    or ``sample_window_duration`` has passed.  A batch that is replayed after a
    failure is recognised by its number and counted once.
    """

    def __init__(self, spark: SparkSession, config: Config) -> None:
        spool.register(spark)
        self.spark, self.config = spark, config
        self.path, self.written, self._query = "", 0, None
        self._last, self._until = -1, None

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self, rows: DataFrame, trigger: str = "1 second") -> int:
        """0: started; 1: already running."""
        if self.running:
            return 1
        began = dt.datetime.now()
        home = self.config.spool_dir or scratch(self.spark, "spool")
        self.path, self.written, self._last = f"{home}/samples_{began:%Y%m%d_%H%M%S_%f}", 0, -1
        self._until = began + dt.timedelta(seconds=self.config.sample_window_duration) if self.config.sample_window_duration else None
        stream = rows.writeStream.foreachBatch(self._take).option("checkpointLocation", scratch(self.spark, "sampler"))
        self._query = stream.trigger(processingTime=trigger).start()
        return 0

    def stop(self) -> int:
        """0: stopped; 1: not running."""
        if not self.running:
            return 1
        self._query.stop()
        return 0

    def status(self) -> dict[str, object]:
        return {"configured": True, "running": self.running, "bytes_written": self.written, "path": self.path}

    def _take(self, batch: DataFrame, number: int) -> None:
        left = (self.config.spool_max_bytes or 64 << 20) - self.written
        if number <= self._last or left <= 0 or (self._until and dt.datetime.now() >= self._until):
            return
        chosen = settle(spool_records(batch, dataclasses.replace(self.config, spool_max_bytes=left)), "sampled")
        chosen.select("key", "value").write.format("kvspool").mode("append").save(self.path)
        size = F.lit(8) + F.octet_length("key") + F.octet_length("value")
        self.written += chosen.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        self._last = number
