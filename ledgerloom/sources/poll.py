"""Polling cycles: from the stored progress to the head, raw logs first, then the progress."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PROGRESS
from ..operators.ranges import resolve_start
from .progress import restore
from .retry import RpcClient
from .rpc import register

ENTRY = f"{PROGRESS}, log_offset bigint"


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(folder)


def poll_cycle(spark: SparkSession, network: str, url: str, contracts: dict[str, int | None], progress: str, write: Callable[[DataFrame], None], max_block_range: int = 2_000, clock: Callable[[], int] = lambda: int(time.time() * 1000), **options: str) -> int:
    """One cycle over the contracts (address: start block or None): logs go to `write`, then the head is noted for each. Returns the head.

    The progress has a row a contract, so its current rows are held by the driver, like the contracts.
    """
    register(spark)
    head = RpcClient(url).block_number()
    wanted = {a.lower(): start for a, start in contracts.items()}
    if not wanted:
        return head
    known = {r["progress_key"].rsplit(":", 1)[1]: r["last_block"] for r in restore(read_progress(spark, progress)).where(F.col("progress_key").startswith(f"{network}:")).collect()}
    starts = {a: resolve_start(known.get(a), start, head) for a, start in wanted.items()}
    due = {a: s for a, s in starts.items() if s <= head}
    if due:
        logs = spark.read.format("evm_rpc").options(network=network, url=url, addresses=",".join(sorted(due)), startBlocks=json.dumps(due), endBlock=str(head), maxBlockRange=str(max_block_range), **options).load()
        write(logs)
        now = clock()
        rows = [(f"{network}:{a}", head, now, time.time_ns()) for a in sorted(due)]
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").json(progress)
    return head
