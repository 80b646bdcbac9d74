"""Raw logs of drivers outside Spark, as files that streams read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..model import RAW_LOG


class RawLogWriter:
    """Collects rows and appends them as one Parquet file when there are `rows` of them or the first is `seconds` old."""

    def __init__(self, spark: SparkSession, folder: str, rows: int = 1_000, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.rows, self.seconds, self.clock = spark, folder, rows, seconds, clock
        self.held: list[tuple] = []
        self.since = 0.0

    def emit(self, rows: list[tuple]) -> None:
        if rows and not self.held:
            self.since = self.clock()
        self.held += rows
        if len(self.held) >= self.rows or self.held and self.clock() - self.since >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, RAW_LOG).coalesce(1).write.mode("append").parquet(self.folder)
            self.held = []
