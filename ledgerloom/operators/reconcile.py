"""Set-based reconciliation: each event key once. lifecycle_batch is exact where keys are seen again after completion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_NETWORKS, NetworkParams
from .blocks import known_heads

KEY = ["network", "tx_hash", "log_index"]


def merge_sightings(decoded: DataFrame) -> DataFrame:
    """Per key: seen_ws, seen_poll, first_seen, block_number and decoded_fields (the last poll decode, else the first), n_sightings. One shuffle."""
    poll, ws = F.col("source") == "POLL", F.col("source") == "WS"
    chosen = F.struct("block_number", "decoded_fields")
    merged = decoded.groupBy(*KEY).agg(
        F.bool_or(ws).alias("seen_ws"),
        F.bool_or(poll).alias("seen_poll"),
        F.min("observed_at").alias("first_seen"),
        F.coalesce(F.max_by(F.when(poll, chosen), F.when(poll, F.col("seq"))), F.min_by(chosen, "seq")).alias("e"),
        F.count("*").alias("n_sightings"),
    )
    return merged.select(*KEY, "seen_ws", "seen_poll", "first_seen", "e.block_number", "e.decoded_fields", "n_sightings")


def divergent(decoded: DataFrame, fields: str = "decoded_fields") -> DataFrame:
    """Keys whose first push and first poll decodes differ. `fields` must be canonical."""
    first = lambda source: F.min_by(F.when(F.col("source") == source, F.col(fields)), F.when(F.col("source") == source, F.col("seq")))
    both = decoded.groupBy(*KEY).agg(first("WS").alias("ws_fields"), first("POLL").alias("poll_fields"))
    return both.where("ws_fields <> poll_fields").withColumn("anomaly", F.lit("DIVERGENT_DECODE"))


def gap_anomalies(merged: DataFrame, heads: DataFrame, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS) -> DataFrame:
    """One-sided keys whose block is at least the network's gap below its head. Heads: a row a network."""
    due = merged.join(known_heads(heads, networks), "network").where(F.col("last_block") - F.col("block_number") >= F.col("gap"))
    kind = F.when(F.col("seen_poll") & ~F.col("seen_ws"), "WS_GAP_SUSPECTED").when(F.col("seen_ws") & ~F.col("seen_poll"), "POLL_ONLY_CONFIRMED")
    details = F.concat(F.lit("seenWs="), F.col("seen_ws").cast("string"), F.lit(" seenPoll="), F.col("seen_poll").cast("string"), F.lit(" firstSeenAtEpochMillis="), F.col("first_seen").cast("string"))
    return due.withColumn("anomaly", kind).where("anomaly is not null").select(*KEY, "block_number", "anomaly", details.alias("details"))
