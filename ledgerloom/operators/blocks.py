"""Block heights: heads, ancestry windows, reorganisations, and confirmation by distance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_NETWORKS, RETENTION_BLOCKS, SWEEP_BLOCKS, NetworkParams, with_params


def heads(raw: DataFrame) -> DataFrame:
    """The highest block of each network."""
    return raw.groupBy("network").agg(F.max("block_number").alias("last_block"))


#: Rows that a bucket of seq has, about.
BUCKET_ROWS = 4_096


def seq_width(rows: DataFrame, bucket_rows: int | None = None) -> int:
    """The width of buckets of seq, however seq is spaced, that have BUCKET_ROWS rows on average."""
    low, high, n = rows.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    return max(1, -(-(high - low + 1) // max(1, n // (bucket_rows or BUCKET_ROWS)))) if n else 1


def running_heads(raw: DataFrame) -> DataFrame:
    """For each row the highest block of its network so far. Rows are dealt by network and seq bucket, so that a busy network is
    not one task: a maximum within the bucket, and the maximum over the buckets before it (one row a bucket)."""
    bucket = seq_width(raw)
    dealt = raw.select("network", "seq", "block_number", F.floor(F.col("seq") / bucket).alias("bucket"))
    tops = dealt.groupBy("network", "bucket").agg(F.max("block_number").alias("top"))
    earlier = tops.withColumn("earlier", F.max("top").over(Window.partitionBy("network").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = F.max("block_number").over(Window.partitionBy("network", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("inside", inside).join(earlier, ["network", "bucket"]).select("network", "seq", "block_number", F.greatest("inside", "earlier").alias("last_block"))


def ancestry_window(raw: DataFrame, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS) -> DataFrame:
    """The kept heights of each network (the last depth + 10) with their latest hash. The head is joined, not sorted for."""
    blocks = raw.groupBy("network", "block_number").agg(F.max_by("block_hash", "seq").alias("block_hash"))
    top = known_heads(heads(raw), networks)
    return blocks.join(top, "network").where(F.col("block_number") > F.col("last_block") - (F.col("depth") + RETENTION_BLOCKS)).select("network", "block_number", "block_hash")


def reorgs(raw: DataFrame) -> DataFrame:
    """Rows at which a height is seen again under another hash: network, block_number, seq, old_hash, block_hash."""
    before = F.lag("block_hash").over(Window.partitionBy("network", "block_number").orderBy("seq"))
    return raw.select("network", "block_number", "seq", "block_hash", before.alias("old_hash")).where("old_hash <> block_hash")


def known_heads(last: DataFrame, networks: Mapping[str, NetworkParams]) -> DataFrame:
    """Heads with their networks' depth and gap: a row a configured network at most, so it may be broadcast; an unknown one fails."""
    return F.broadcast(with_params(last, networks))


def confirmations(events: DataFrame, last: DataFrame, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS) -> DataFrame:
    """Adds last_block, depth, gap, confirmations_seen (never below 0 nor above 32 bits)."""
    joined = events.join(known_heads(last, networks), "network")
    return joined.withColumn("confirmations_seen", F.least(F.greatest(F.col("last_block") - F.col("block_number"), F.lit(0)), F.lit(2**31 - 1)).cast("int"))


def promoted(seen: DataFrame) -> DataFrame:
    return seen.where("confirmations_seen >= depth").withColumn("status", F.lit("CONFIRMED"))


def swept(seen: DataFrame) -> DataFrame:
    """Terminal rows that are so deep that their state is dropped."""
    return seen.where(F.col("last_block") - F.col("block_number") > F.col("depth") + SWEEP_BLOCKS)


def invalidated(decoded: DataFrame, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS) -> DataFrame:
    """Events (rows with the lifecycle's columns) whose height was reorganised while they were unconfirmed; what was confirmed
    before stays so. seq is that of the reorganisation."""
    from ..lifecycle.batch import lifecycle_batch

    return lifecycle_batch(decoded, networks).where("status = 'INVALIDATED'")
