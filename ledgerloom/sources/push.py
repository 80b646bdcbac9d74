"""The push source: frames, reconnects with catch-up, and rows into a folder that a stream reads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import catchup
from .retry import RpcClient, RpcError, reconnect_ms
from .rpc import Arrivals, to_row


def frame_kind(text: str) -> str:
    """NOTIFICATION if it names a method, else ACK; OTHER if it isn't a JSON object."""
    try:
        value = json.loads(text)
    except ValueError:
        return "OTHER"
    return "OTHER" if not isinstance(value, dict) else "NOTIFICATION" if "method" in value else "ACK"


def frame_kind_column(c: Column | str = "value") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.get_json_object(c, "$.method").isNotNull(), "NOTIFICATION").otherwise("ACK")


def notified_logs(frames: DataFrame, network: str) -> DataFrame:
    """Wire logs in subscription frames, as columns."""
    wire = "struct<params:struct<result:struct<address:string,blockHash:string,blockNumber:string,data:string,logIndex:string,topics:array<string>,transactionHash:string>>>"
    return frames.where(frame_kind_column() == "NOTIFICATION").select(F.from_json("value", wire).alias("f")).select(F.lit(network).alias("network"), "f.params.result.*")


class PushIngestion:
    """Streams logs of one network: after each (re)connect the blocks since the last seen one are fetched first, all as WS.

    `connect(addresses)` yields text frames until the connection ends, and None when there has been none for a while;
    `emit(rows)` stores raw-log rows. The addresses are looked up again every `refresh_ms`; when they have changed, the source
    connects anew at once.
    """

    def __init__(self, network: str, rpc: RpcClient, connect: Callable[[list[str]], Iterable[str | None]], addresses: Callable[[], list[str]], emit: Callable[[list[tuple]], None], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], int] = lambda: int(time.time() * 1000), refresh_ms: int = 5_000):
        self.network, self.rpc, self.connect, self.addresses, self.emit, self.sleep, self.clock, self.refresh_ms = network, rpc, connect, addresses, emit, sleep, clock, refresh_ms
        self.last_seen: int | None = None
        self.arrivals = Arrivals("WS", 0, clock)
        self.changed = False

    def _rows(self, logs: Iterable[dict]) -> list[tuple]:
        return [to_row(x, self.network, "WS", self.clock(), self.arrivals.next()) for x in logs]

    def _watched(self) -> list[str]:
        return list(dict.fromkeys(self.addresses()))

    def _frames(self, wanted: list[str]) -> Iterator[dict]:
        looked = self.clock()
        for text in self.connect(wanted):
            if self.clock() - looked >= self.refresh_ms:
                looked = self.clock()
                self.changed = self._watched() != wanted
            kind = "OTHER" if text is None else frame_kind(text)
            if kind == "ACK" and json.loads(text).get("error"):
                raise RuntimeError(f"subscribing failed: {json.loads(text)['error']}")
            if kind == "NOTIFICATION":
                yield json.loads(text)["params"]["result"]
            if self.changed:
                return

    def run(self, connections: int | None = None) -> None:
        """So many connections, one after the other; without a number, until it is interrupted."""
        failures = 0
        for turn in count() if connections is None else range(connections):
            if turn and not self.changed:
                failures += 1
                self.sleep(reconnect_ms(failures) / 1000)
            self.changed = False
            wanted, before = self._watched(), self.last_seen
            try:
                head = self.rpc.block_number() if turn or self.last_seen is None else self.last_seen
                missed = catchup(self.last_seen, head) if turn else None
                if missed:
                    self.emit(self._rows(self.rpc.logs(*missed, wanted)))
                self.last_seen = head if self.last_seen is None or turn else self.last_seen
                for log in self._frames(wanted):
                    (row,) = self._rows([log])
                    self.emit([row])
                    self.last_seen, failures = max(self.last_seen, row[4]), 0
            except (OSError, RpcError) as error:
                if connections is not None and turn == connections - 1:
                    raise
                self.last_error = error
                self.last_seen = before if self.last_seen is None else self.last_seen
