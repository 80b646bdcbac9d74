"""The engine's Python interface: subscriptions, decoding, lifecycle, results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .abi.registry import AbiRegistry
from .abi.types import AbiError
from .config import DEFAULT_NETWORKS, NetworkParams
from .lifecycle.batch import IN, lifecycle_batch
from .lifecycle.core import Options
from .model import RAW_LOG, SUBSCRIPTION
from .operators import decode as decoding
from .operators.resolve import dead_letters, latest, list_subscriptions, where_events_included
from .sinks import topics
from .sinks.confirmed import ConfirmedEvents
from .sinks.rawlogs import RawLogWriter
from .sinks.topics import provision
from .sources.poll import poll_cycle
from .sources.subscriptions import contracts
from .streaming.lifecycle import lifecycle_stream, resolve_stream, split_outputs

CHANGE = f"{SUBSCRIPTION}, seq bigint"


RAW_COLUMNS = [c.strip().split(" ")[0] for c in RAW_LOG.split(",")]


class Running:
    """The engine's two queries."""

    def __init__(self, first, second: Callable, ends: bool):
        self.first, self.ends = first, ends
        self.open = second
        self.second = None if ends else second()

    def awaitTermination(self) -> None:
        self.first.awaitTermination()
        if self.second is None:
            self.second = self.open()
        self.second.awaitTermination()

    def stop(self) -> None:
        for query in (self.first, self.second):
            if query is not None:
                query.stop()


class Engine:
    def __init__(self, spark: SparkSession, path: str, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS, registry: AbiRegistry | None = None, options: Options = Options(), prefer_active: bool = False, enforce_include_events: bool = False, clock=lambda: int(time.time() * 1000)):
        self.spark, self.path, self.networks, self.registry = spark, path.rstrip("/"), dict(networks), registry or AbiRegistry()
        self.options, self.prefer_active, self.enforce_include_events, self.clock = options, prefer_active, enforce_include_events, clock
        provision(spark, self.path)
        self.results = ConfirmedEvents(spark, f"{self.path}/results")
        self.results.create()

    # Subscriptions: an append-only change log, compacted when read.
    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGE).option("recursiveFileLookup", "true").json(f"{self.path}/subscriptions")

    def _append(self, record: dict) -> dict:
        self.spark.createDataFrame([record], CHANGE).coalesce(1).write.mode("append").json(f"{self.path}/subscriptions")
        return record

    def subscribe(self, network: str, address: str, abi_ref: str, start_block: int | None = None, include_events: Sequence[str] = ()) -> dict:
        """Stores and returns the subscription; an interface that can't be used is refused first."""
        try:
            self.registry.get(abi_ref)
        except AbiError as error:
            raise ValueError(f"abiRef '{abi_ref}' can't be used: {error}") from error
        now = self.clock()
        return self._append({"id": str(uuid.uuid4()), "network": network, "address": address, "abi_ref": abi_ref, "start_block": start_block, "include_events": list(include_events), "status": "ACTIVE", "created_at": now, "seq": time.time_ns()})

    def unsubscribe(self, id_: str) -> dict:
        found = self.subscriptions(status="ALL").where(F.col("id") == id_).collect()
        if not found:
            raise KeyError(id_)
        return self._append({**found[0].asDict(), "status": "REMOVED", "seq": time.time_ns()})

    def subscription(self, id_: str) -> dict | None:
        """One subscription as it is now, whatever its status."""
        found = self.subscriptions(status="ALL").where(F.col("id") == id_).collect()
        return found[0].asDict() if found else None

    def subscriptions(self, network: str | None = None, status: str | None = "ACTIVE") -> DataFrame:
        return list_subscriptions(latest(self.changes(), ["id"], "seq").drop("seq"), network, status)

    # Events.
    def decode_all(self, raw: DataFrame) -> DataFrame:
        current = self.subscriptions(status="ALL")
        out = decoding.decode_all(raw, current, self.registry, self.prefer_active)
        if not self.enforce_include_events:
            return out
        kept = where_events_included(out.where("reason is null"), current)
        return out.where("reason is not null").unionByName(kept)

    def lifecycle(self, raw: DataFrame) -> DataFrame:
        return lifecycle_batch(self.decode_all(raw), self.networks, self.options)

    def resolved(self, raw: DataFrame, changes: DataFrame) -> DataFrame:
        """Streams of raw logs and subscription changes (each with seq) as raw logs with abi_ref, their decode, and reason."""
        resolved = resolve_stream(raw, changes)
        both = decoding.with_decode(resolved, self.registry, F.col("reason").isNull())
        return both.withColumns({"event_name": F.col("d.event_name"), "signature_hash": F.col("d.signature_hash"), "decoded_fields": F.col("d.decoded_fields"), "reason": F.coalesce("reason", "d.error")}).drop("d")

    def stream(self, raw: DataFrame, changes: DataFrame) -> DataFrame:
        """The lifecycle's outputs over streams of raw logs and subscription changes."""
        return lifecycle_stream(self.resolved(raw, changes), self.networks, self.options)

    def _put(self, topic: str, name: str, df: DataFrame) -> None:
        """A batch as a folder of its own: a batch that is run again replaces it."""
        df.write.mode("overwrite").parquet(f"{self.path}/{topic}/{name}")

    def topic(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.option("recursiveFileLookup", "true")
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{name}")

    def start(self, raw: DataFrame, changes: DataFrame, checkpoint: str, files_a_trigger: int = 64, **trigger) -> Running:
        """Runs two queries: one stores decoded logs and dead letters, the next takes all logs from there through the lifecycle and stores
        confirmations, invalidations and anomalies. With availableNow (the default) the second starts when the first has ended."""
        trigger = trigger or {"availableNow": True}
        both = self.resolved(raw, changes)
        name = lambda batch: f"batch-{batch:012d}"

        def decoded(batch: DataFrame, number: int) -> None:
            batch.persist()
            self._put("decoded-logs", name(number), decoding.envelopes(batch))
            self._put("decode-dead-letters", name(number), dead_letters(batch, RAW_COLUMNS))
            self._put("decoded-all", name(number), batch.select(*IN))
            batch.unpersist()

        def ended(batch: DataFrame, number: int) -> None:
            batch.persist()
            self._put("confirmed-events", name(number), split_outputs(batch)[0])
            self._put("reconciliation-anomalies", name(number), split_outputs(batch)[1])
            self.results.upsert(batch)
            batch.unpersist()

        write = lambda df, fn, part: df.writeStream.foreachBatch(fn).option("checkpointLocation", f"{checkpoint}/{part}").outputMode("append").trigger(**trigger).queryName(part)
        schema = both.select(*IN).schema
        topics.make(self.spark, f"{self.path}/decoded-all")

        def second():
            logs = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{self.path}/decoded-all/*")
            return write(lifecycle_stream(logs, self.networks, self.options), ended, "lifecycle").start()

        return Running(write(both, decoded, "decode").start(), second, "availableNow" in trigger or "once" in trigger)

    # Raw logs.
    def raw_writer(self, **limits) -> RawLogWriter:
        """What a push source emits into."""
        return RawLogWriter(self.spark, f"{self.path}/raw-logs", **limits)

    def poll(self, network: str, url: str, **options) -> int:
        """One polling cycle over the network's active subscriptions: raw logs, then progress. Returns the head."""
        rows = self.subscriptions(network).select("address", "start_block").collect()  # what one poller watches
        watched = contracts([{"address": r["address"], "startBlock": r["start_block"]} for r in rows])
        write = lambda df: df.write.mode("append").parquet(f"{self.path}/raw-logs")
        return poll_cycle(self.spark, network, url, watched, f"{self.path}/poll-progress", write, **options)

    # Results.
    def upsert_confirmed(self, outputs: DataFrame) -> None:
        self.results.upsert(outputs)

    def find_by_key(self, network: str, tx_hash: str, log_index: int) -> DataFrame:
        return self.results.find(network, tx_hash, log_index)

    def snapshot(self) -> DataFrame:
        return self.results.snapshot()

    def count_for_key(self, network: str, tx_hash: str, log_index: int) -> int:
        return self.results.count_for_key(network, tx_hash, log_index)


def state_of(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """A streaming state variable as rows: tracking, entries or subscriptions."""
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(checkpoint)
