"""Poll progress: the last polled block of each contract, in a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.resolve import latest


def restore(progress: DataFrame, order: str = "log_offset") -> DataFrame:
    """progress_key and its last written block."""
    return latest(progress, ["progress_key"], order).select("progress_key", "last_block")
