"""The engine's logical tables as folders, made once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Topic:
    name: str
    key: str
    partitions: int
    compacted: bool


TOPICS = (
    Topic("subscriptions", "id", 3, True),
    Topic("raw-logs", "event key", 6, False),
    Topic("decoded-logs", "event key", 6, False),
    Topic("decode-dead-letters", "event key", 1, False),
    Topic("confirmed-events", "event key", 6, False),
    Topic("reconciliation-anomalies", "event key", 3, False),
    Topic("poll-progress", "network:address", 3, True),
)


def make(spark: SparkSession, folder: str) -> bool:
    """Makes a folder; whether it was missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(path) and bool(fs.mkdirs(path))


def provision(spark: SparkSession, folder: str) -> list[str]:
    """Makes the folders that are missing, and names them. Another process may be doing the same."""
    return [t.name for t in TOPICS if make(spark, f"{folder.rstrip('/')}/{t.name}")]
