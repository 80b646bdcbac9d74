"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet files. A file's tier is the number of times its size can be multiplied by
FAN_IN before it reaches the target. Runs of files in one tier are merged as soon as they have FAN_IN files or fill a
target-sized file; a merge reads its files in one task and writes one file, without a shuffle; the merges of a job run side by
side, a task each. Files of the target's size are left alone. After each step one manifest names the live files; it is written under a temporary name and renamed
to its version, which fails if that version exists, so of two writers one wins and the other starts over from what it
finds. Readers see one version; files of older ones stay until `vacuum`.

All of it lives in one folder of a file system that Spark can reach (the shared folder in queries).

Defined cases: null columns are stored as they are; empty texts too; repeated rows stay repeated; an empty arrival commits a
version without new files; extra columns are stored; columns must be those of the store's first arrival.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, get_text, put_new, work_dir

TARGET_BYTES, FAN_IN, ARRIVAL_ROWS = 32 << 20, 4, 4000
#: Merges that one job runs, each in a task of its own.
MERGES_A_JOB = 256


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    files: list[dict] = field(default_factory=list)  # path (below the store), bytes, rows, made (the version that wrote it)


def tier(size: int, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
    """0: the target's size or near it; each tier above is fan_in times smaller."""
    return max(0, math.ceil(math.log(target / max(size, 1), fan_in) - 0.5))


def plan_merges(files: list[dict], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[dict]]:
    """Runs of files to merge: within a tier, smallest first, up to the target's size, at least two files and fan_in of them or full."""
    tiers: dict[int, list[dict]] = {}
    for f in files:
        tiers.setdefault(tier(f["bytes"], target, fan_in), []).append(f)
    merges = []
    for t in sorted(tiers, reverse=True):
        if not t:
            continue
        run: list[dict] = []
        for f in sorted(tiers[t], key=lambda f: (f["bytes"], f["path"])):
            if run and sum(x["bytes"] for x in run) + f["bytes"] > target:
                if len(run) > 1:
                    merges.append(run)
                run = []
            run.append(f)
        if len(run) >= fan_in:
            merges.append(run)
    return merges


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.folder, self.target, self.fan_in = spark, folder.rstrip("/"), target, fan_in

    # The file system, by the driver's JVM, so that any that Spark knows will do.
    def _path(self, name: str):
        return file_system(self.spark, f"{self.folder}/{name}")[1]

    def _fs(self):
        return file_system(self.spark, self.folder)[0]

    def _list(self, name: str) -> list[tuple[str, int]]:
        fs, path = self._fs(), self._path(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n, _ in self._list("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None and not known:
            return Manifest()
        name = f"manifests/{(max(known) if version is None else version):012d}.json"
        return Manifest(**json.loads(get_text(self.spark, f"{self.folder}/{name}")))

    def commit(self, after: Manifest, schema: str, files: list[dict]) -> Manifest:
        """The version that follows `after`, or Conflict; nobody sees half of it."""
        new = Manifest(after.version + 1, schema, files)
        if not put_new(self.spark, f"{self.folder}/manifests/{new.version:012d}.json", json.dumps(new.__dict__).encode()):
            raise Conflict(new.version)
        return new

    def _written(self, name: str) -> list[dict]:
        return [{"path": f"{name}/{n}", "bytes": size} for n, size in self._list(name) if n.startswith("part-") and n.endswith(".parquet")]

    def append(self, arrivals: DataFrame, rows_a_file: int = ARRIVAL_ROWS) -> Manifest:
        """Stores the rows as small files, in their present partitions, and commits them."""
        while True:
            now = self.manifest()
            name = f"data/{now.version + 1:012d}-{self._token()}"
            arrivals.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(f"{self.folder}/{name}")
            try:
                return self.commit(now, arrivals.schema.json(), [*now.files, *({**f, "made": now.version + 1} for f in self._written(name))])
            except Conflict:
                self._fs().delete(self._path(name), True)

    def _token(self) -> str:
        import uuid

        return uuid.uuid4().hex[:8]

    def read(self, version: int | None = None, files: list[dict] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        now = self.manifest(version)
        live = now.files if files is None else files
        schema = StructType.fromJson(json.loads(now.schema))
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f['path']}" for f in live])

    def _merge(self, merges: list[list[dict]], name: str) -> None:
        """Writes each run of files as one file, by one task a run."""
        parts = [self.read(files=run).coalesce(1) for run in merges]
        # A union of single partitions is one partition unless this is off; the number is looked at before anything is written.
        with _setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):
            both = reduce(DataFrame.union, parts)
            whole = [both] if both._jdf.queryExecution().toRdd().getNumPartitions() == len(merges) else parts
            for df in whole:
                df.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def compact(self) -> Manifest:
        """Merges until no tier has a run to merge. Each job's merges are committed together."""
        while True:
            now = self.manifest()
            merges = plan_merges(now.files, self.target, self.fan_in)[:MERGES_A_JOB]
            if not merges:
                return now
            name = f"data/{now.version + 1:012d}-{self._token()}"
            self._merge(merges, name)
            gone = {f["path"] for run in merges for f in run}
            try:
                self.commit(now, now.schema, [*(f for f in now.files if f["path"] not in gone), *({**f, "made": now.version + 1} for f in self._written(name))])
            except Conflict:
                self._fs().delete(self._path(name), True)

    def vacuum(self) -> int:
        """Deletes the files that the last version does not name; returns how many."""
        live, gone = {f["path"] for f in self.manifest().files}, 0
        for folder, _ in self._list("data"):
            for name, _ in self._list(f"data/{folder}"):
                if name.startswith("part-") and f"data/{folder}/{name}" not in live:
                    self._fs().delete(self._path(f"data/{folder}/{name}"), False)
                    gone += 1
        return gone


def sharded(docs: DataFrame, target: int = TARGET_BYTES, fan_in: int = FAN_IN, rows_a_file: int = ARRIVAL_ROWS) -> DataFrame:
    """Appends the rows to a new store, compacts and vacuums it; one row per stored row: doc_id, shard, shard_bytes, tier, version, n_bytes, text_sha256 (all as read back)."""
    spark = docs.sparkSession
    store = ShardStore(spark, work_dir(spark, "shards"), target, fan_in)
    store.append(docs, rows_a_file)
    now = store.compact()
    store.vacuum()
    rows = store.read().select("doc_id", F.col("text").alias("t"), F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3)).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
    ratio = F.log(F.lit(float(target)) / F.greatest("shard_bytes", F.lit(1))) / math.log(fan_in)
    return rows.select("doc_id", "shard", "shard_bytes", F.greatest(F.ceil(ratio - 0.5), F.lit(0)).cast("int").alias("tier"), F.lit(now.version).alias("version"), F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("t", F.lit("")), 256).alias("text_sha256"))


def op10_size_tiered_shards(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
