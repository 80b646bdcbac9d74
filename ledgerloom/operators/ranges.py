"""Block ranges: where a poll starts, how it is cut, and what a reconnect has missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Inclusive ranges of at most `most` blocks, in order, none if start is above end."""
    if most <= 0:
        raise ValueError("the block range must be positive")
    return [(a, min(a + most - 1, end)) for a in range(start, end + 1, most)]


def resolve_start(last_polled: int | None, start_block: int | None, head: int) -> int:
    return last_polled + 1 if last_polled is not None else start_block if start_block is not None else head


def catchup(last_seen: int | None, head: int) -> tuple[int, int] | None:
    return None if last_seen is None or last_seen + 1 > head else (last_seen + 1, head)


def start_column(last: str = "last_block", start: str = "start_block", head: str = "head") -> Column:
    return F.coalesce(F.col(last) + 1, F.col(start), F.col(head))


def planned(contracts: DataFrame, most: int, start: str = "start", end: str = "head") -> DataFrame:
    """A row for each range of each contract: range_from, range_to."""
    if most <= 0:
        raise ValueError("the block range must be positive")
    steps = F.sequence(F.col(start), F.col(end), F.lit(most).cast("bigint"))
    return contracts.where(F.col(start) <= F.col(end)).withColumn("range_from", F.explode(steps)).withColumn("range_to", F.least(F.col("range_from") + most - 1, F.col(end)))


def catchup_columns(df: DataFrame, last: str = "last_seen", head: str = "head") -> DataFrame:
    """catchup_from and catchup_to, both null without a baseline or a gap."""
    some = F.col(last).isNotNull() & (F.col(last) + 1 <= F.col(head))
    return df.withColumn("catchup_from", F.when(some, F.col(last) + 1)).withColumn("catchup_to", F.when(some, F.col(head)))
