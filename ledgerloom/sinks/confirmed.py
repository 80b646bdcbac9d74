"""The confirmed-events table: idempotent upserts, snapshots and look-ups."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["network", "tx_hash", "log_index"]
COLUMNS = ["event_name", "signature_hash", "network", "contract_address", "tx_hash", "log_index", "block_number", "status", "source", "decoded_fields"]
#: Runs of a level that are merged into one of the next.
MERGE_RUNS = 8
SCHEMA = "event_name string, signature_hash string, network string, contract_address string, tx_hash string, log_index bigint, block_number bigint, status string, source string, decoded_fields string, seq bigint, ord int"


def latest_rows(outputs: DataFrame) -> DataFrame:
    """The last state of each key: replaying any of the outputs changes nothing."""
    rest = [c for c in COLUMNS if c not in KEY]
    last = outputs.groupBy(*KEY).agg(F.max_by(F.struct(*rest, "seq", "ord"), F.struct("seq", "ord")).alias("r"))
    return last.select(*KEY, "r.*").select(*COLUMNS, "seq", "ord")


class ConfirmedEvents:
    """Runs of rows in a folder, like a log-structured table: a batch is stored as a run of its own, without reading the others, and a
    small file that names the live runs is put beside them, whole or not at all. Readers take the last row of each key over
    the live runs. When a level has MERGE_RUNS runs, they are merged into one of the next level, so a row is written again once a
    level. Runs that the last two lists don't name are removed.

    Rows are partitioned by network and, within files, clustered by block. Batches are applied at least once; a
    row older than what is stored for its key is passed over, so repeats and restarts do no harm. There is one writer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def create(self) -> None:
        """Makes the folder if it is not there."""
        fs, path = self._fs("")
        fs.mkdirs(path)

    def _lists(self) -> list[str]:
        fs, path = self._fs("")
        names = (s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else ()
        return sorted(n for n in names if n.startswith("live-") and n.endswith(".json"))

    def runs(self, name: str | None = None) -> list[dict]:
        """The live runs: name and level."""
        names = self._lists()
        if not names:
            return []
        fs, path = self._fs(name or names[-1])
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, runs: list[dict]) -> None:
        names = self._lists()
        number = int(names[-1][5:17]) + 1 if names else 1
        fs, temporary = self._fs(f".live-{number:012d}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        if not fs.rename(temporary, self._fs(f"live-{number:012d}.json")[1]):
            raise RuntimeError(f"list {number} of {self.folder} was written by another")
        if len(names) > 1:
            gone = {r["run"] for r in self.runs(names[0])} - {r["run"] for r in [*runs, *self.runs(names[-1])]}
            for run in (*gone, names[0]):
                fs.delete(self._fs(run)[1], True)

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], SCHEMA)
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{r['run']}") for r in runs]
        return reduce(DataFrame.unionByName, parts)

    def _store(self, rows: DataFrame, level: int) -> dict:
        run = f"run-{uuid.uuid4().hex}"
        latest_rows(rows).repartition("network", F.floor(F.col("block_number") / 10_000)).sortWithinPartitions("network", "block_number", "status").write.partitionBy("network").parquet(f"{self.folder}/{run}")
        return {"run": run, "level": level}

    def read(self) -> DataFrame:
        return latest_rows(self._read(self.runs()))

    def upsert(self, outputs: DataFrame) -> None:
        """Stores confirmations and invalidations (of lifecycle outputs, or rows in SCHEMA)."""
        fresh = outputs.where("kind = 'CONFIRMATION'") if "kind" in outputs.columns else outputs
        runs = [*self.runs(), self._store(fresh.select(*COLUMNS, "seq", "ord"), 0)]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= MERGE_RUNS:
            runs = [*(r for r in runs if r["level"] != level), self._store(self._read(full), level + 1)]
            level += 1
        self._name(runs)

    def truncate(self) -> None:
        fs, path = self._fs("")
        fs.delete(path, True)
        self.create()

    def find(self, network: str, tx_hash: str, log_index: int) -> DataFrame:
        """The key's row; the filter reaches the files of every run."""
        return self.read().where((F.col("network") == network) & (F.col("tx_hash") == tx_hash) & (F.col("log_index") == log_index)).select(*COLUMNS)

    def snapshot(self) -> DataFrame:
        return self.read().select(*COLUMNS).orderBy(*KEY)

    def count(self) -> int:
        return self.read().count()

    def count_for_key(self, network: str, tx_hash: str, log_index: int) -> int:
        return self.find(network, tx_hash, log_index).count()

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: the offsets are committed after the upsert returns."""
        return lambda batch, _: self.upsert(batch)


#: The result table's columns in a database and their types.
TYPES = {"network": "VARCHAR(64)", "tx_hash": "VARCHAR(128)", "log_index": "BIGINT", "event_name": "VARCHAR(255)", "signature_hash": "VARCHAR(128)", "contract_address": "VARCHAR(128)", "block_number": "BIGINT", "status": "VARCHAR(32)", "source": "VARCHAR(16)", "decoded_fields": "{json}"}


def migrations(json_type: str = "JSONB", gin: bool = True) -> list[str]:
    """Statements that make the table, its key and its indexes (those that can be, also where they exist)."""
    columns = [f"{name} {kind.format(json=json_type)} NOT NULL" for name, kind in TYPES.items()]
    stamps = [f"{name} TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP" for name in ("created_at", "updated_at")]
    key = f"CONSTRAINT confirmed_events_key UNIQUE ({', '.join(KEY)})"
    indexes = {"block": "(network, block_number)", "status": "(status)"} | ({"fields": "USING GIN (decoded_fields)"} if gin else {})
    made = [f"CREATE INDEX IF NOT EXISTS confirmed_events_{n} ON confirmed_events {on}" for n, on in indexes.items()]
    return [f"CREATE TABLE IF NOT EXISTS confirmed_events ({', '.join([*columns, *stamps, key])})", *made]


def migrate(connection, **kinds) -> None:
    """Runs the statements on a DB-API connection."""
    cursor = connection.cursor()
    for statement in migrations(**kinds):
        cursor.execute(statement)
    connection.commit()


def upsert_sql(mark: str = "%s") -> str:
    """An insert that replaces all but the key; `mark` stands for a value in the driver's style."""
    others = [c for c in COLUMNS if c not in KEY]
    changed = ", ".join([*(f"{c} = EXCLUDED.{c}" for c in others), "updated_at = CURRENT_TIMESTAMP"])
    return f"INSERT INTO confirmed_events ({', '.join(COLUMNS)}) VALUES ({', '.join([mark] * len(COLUMNS))}) ON CONFLICT ({', '.join(KEY)}) DO UPDATE SET {changed}"


def database_sink(connect: Callable, rows_a_batch: int = 500, mark: str = "%s") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts into a database that knows ON CONFLICT; `connect` makes a DB-API connection on the executors."""

    statement = upsert_sql(mark)

    def write(batch: DataFrame, _: int) -> None:
        def part(rows) -> None:
            connection = connect()
            try:
                cursor, held = connection.cursor(), []
                for row in rows:
                    held.append(tuple(row[c] for c in COLUMNS))
                    if len(held) >= rows_a_batch:
                        cursor.executemany(statement, held)
                        held = []
                if held:
                    cursor.executemany(statement, held)
                connection.commit()
            finally:
                connection.close()

        latest_rows(batch.where("kind = 'CONFIRMATION'")).select(*COLUMNS).foreachPartition(part)

    return write
