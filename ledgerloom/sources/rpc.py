"""Raw logs from a JSON-RPC node as a Spark data source, batch and streaming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import RAW_LOG
from ..operators.ranges import plan, resolve_start
from .retry import RpcClient, hex_long


class BlockRange(InputPartition):
    def __init__(self, address: str, start: int, end: int, slot: int = 0):
        self.address, self.start, self.end, self.slot = address, start, end, slot


class Arrivals:
    """Rising numbers in the order of arrival: milliseconds (43 bits), a count within them (9), the reader's slot (10), the source (1).

    Sightings of one log by two sources, and a log that is mined again, get different numbers, the later one the greater.
    Readers that run at the same time have different slots (the push source 0; ranges of a poll by their place in it).
    """

    def __init__(self, source: str, slot: int = 0, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.tail = (slot % 1024) << 1 | (source == "POLL")
        self.clock, self.last = clock, 0

    def next(self) -> int:
        self.last = max(self.last + 1, self.clock() << 9)
        return self.last << 11 | self.tail


def to_row(log: dict, network: str, source: str, observed_at: int, seq: int) -> tuple:
    """A wire log as a raw-log row."""
    block, index = hex_long(log["blockNumber"]), hex_long(log["logIndex"])
    return (network, log["address"], log["transactionHash"], index, block, log["blockHash"], list(log.get("topics", [])), log.get("data", "0x"), source, observed_at, seq)


def ranges(contracts: list[tuple[str, int, int]], most: int) -> list[BlockRange]:
    """(address, first, last) cut into ranges, each with a slot."""
    cut = [(a, s, e) for a, first, last in contracts for s, e in plan(first, last, most)]
    return [BlockRange(*x, slot=n + 1) for n, x in enumerate(cut)]


class _Node:
    def __init__(self, options: dict):
        self.network, self.url = options["network"], options["url"]
        self.addresses = [a for a in options.get("addresses", "").split(",") if a]
        self.starts = {k.lower(): int(v) for k, v in json.loads(options.get("startblocks", "{}")).items()}
        self.most = int(options.get("maxblockrange", "2000"))
        self.source = options.get("source", "POLL")
        self.end = int(options["endblock"]) if "endblock" in options else None
        self.client = {"retries": int(options.get("retries", "5")), "initial_ms": int(options.get("initialbackoffms", "200")), "most_ms": int(options.get("maxbackoffms", "10000"))}

    def rpc(self) -> RpcClient:
        return RpcClient(self.url, **self.client)

    def rows(self, part: BlockRange) -> Iterator[tuple]:
        now, arrivals = int(time.time() * 1000), Arrivals(self.source, part.slot)
        for log in self.rpc().logs(part.start, part.end, [part.address]):
            yield to_row(log, self.network, self.source, now, arrivals.next())


class RpcReader(DataSourceReader):
    def __init__(self, node: _Node):
        self.node = node

    def partitions(self) -> list[BlockRange]:
        head = self.node.end if self.node.end is not None else self.node.rpc().block_number()
        return ranges([(a, resolve_start(None, self.node.starts.get(a.lower()), head), head) for a in self.node.addresses], self.node.most)

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        return self.node.rows(partition)


class RpcStreamReader(DataSourceStreamReader):
    """Offsets: the last polled block of each contract, kept in the stream's checkpoint; they only go forward."""

    def __init__(self, node: _Node):
        self.node = node

    def initialOffset(self) -> dict:
        head = self.node.rpc().block_number()
        return {a.lower(): resolve_start(None, self.node.starts.get(a.lower()), head) - 1 for a in self.node.addresses}

    def latestOffset(self) -> dict:
        head = self.node.rpc().block_number()
        return {a.lower(): head for a in self.node.addresses}

    def partitions(self, start: dict, end: dict) -> list[BlockRange]:
        return ranges([(a, resolve_start(start.get(a.lower()), self.node.starts.get(a.lower()), end[a.lower()]), end[a.lower()]) for a in self.node.addresses], self.node.most)

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        return self.node.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RpcDataSource(DataSource):
    """Options: network, url, addresses (by commas), startBlocks (JSON by address), endBlock (batch; else the head), maxBlockRange, retries, initialBackoffMs, maxBackoffMs, source."""

    @classmethod
    def name(cls) -> str:
        return "evm_rpc"

    def schema(self) -> str:
        return RAW_LOG

    def reader(self, schema) -> RpcReader:
        return RpcReader(_Node({k.lower(): v for k, v in self.options.items()}))

    def streamReader(self, schema) -> RpcStreamReader:
        return RpcStreamReader(_Node({k.lower(): v for k, v in self.options.items()}))


def register(spark) -> None:
    spark.dataSource.register(RpcDataSource)
