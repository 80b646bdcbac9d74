"""Subscriptions: compaction, listing, and the lookup join that every raw log goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subscriptions (a row per network and address) are broadcast up to this many; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def latest(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key in a change log. One shuffle, combined before it."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def list_subscriptions(current: DataFrame, network: str | None = None, status: str | None = "ACTIVE") -> DataFrame:
    """Subscriptions of a network (or all) in a status, whatever its case; ALL: in any. Unknown statuses have none."""
    wanted = (status or "ACTIVE").upper()
    out = current if network is None else current.where(F.col("network") == network)
    return out if wanted == "ALL" else out.where(F.col("status") == wanted)


def first_subscription(current: DataFrame, prefer_active: bool = False) -> DataFrame:
    """The subscription that answers for (network, address): that of the least id, ACTIVE or not (`prefer_active`: active first)."""
    order = F.struct((F.col("status") != "ACTIVE").alias("a"), F.col("id")) if prefer_active else F.col("id")
    picked = current.groupBy("network", F.lower("address").alias("address")).agg(F.min_by(F.struct("id", "abi_ref", "status"), order).alias("s"))
    return picked.select(F.col("network").alias("s_network"), F.col("address").alias("s_address"), F.col("s.id").alias("subscription_id"), "s.abi_ref", F.col("s.status").alias("subscription_status"))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the rows are at most `most`, looking no further than that."""
    return df.limit(most + 1).count() <= most


def resolve(raw: DataFrame, current: DataFrame, prefer_active: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """Adds subscription_id, abi_ref, subscription_status and reason (why there is no active subscription, or null)."""
    first = first_subscription(current, prefer_active)
    table = F.broadcast(first) if small(first, most) else first
    joined = raw.join(table, (F.col("network") == F.col("s_network")) & (F.lower("contract_address") == F.col("s_address")), "left").drop("s_network", "s_address")
    at = F.concat(F.lit("network="), "network", F.lit(" address="), "contract_address")
    reason = F.when(F.col("subscription_status").isNull(), F.concat(F.lit("no active subscription found for "), at)).when(F.col("subscription_status") != "ACTIVE", F.concat(F.lit("subscription for "), at, F.lit(" is "), "subscription_status", F.lit(", not ACTIVE")))
    return joined.withColumn("abi_ref", F.coalesce("abi_ref", F.lit("<unresolved>"))).withColumn("reason", reason)


def where_events_included(decoded: DataFrame, current: DataFrame) -> DataFrame:
    """Opt-in: only events that their subscription names, if it names any."""
    names = current.select(F.col("id").alias("i_id"), "include_events")
    joined = decoded.join(names, decoded["subscription_id"] == F.col("i_id"), "left").drop("i_id")
    return joined.where(F.coalesce(F.size("include_events"), F.lit(0)).isin(0, -1) | F.array_contains("include_events", F.col("event_name"))).drop("include_events")


def dead_letters(resolved: DataFrame, raw_columns: list[str], failed_at: Column | None = None) -> DataFrame:
    """Quarantined logs: the log itself, abi_ref, reason, failed_at (the observation's time)."""
    return resolved.where("reason is not null").select(F.struct(*raw_columns).alias("raw_log"), "abi_ref", "reason", (failed_at if failed_at is not None else F.col("observed_at")).alias("failed_at"))
