"""Helpers the text operators share: the shared work folder, bounded text slices and stable hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 4_000_000
#: Rows of 64 bits in which wanted keys are marked: what is broadcast to pick their rows has at most so many rows of two longs.
MARK_WORDS = 1 << 20
#: Tables of up to so many narrow rows are broadcast.
SMALL_ROWS = 100_000

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one a cluster is refused; a local master has a folder of its own until the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def file_system(spark: SparkSession, path: str):
    """(file system, path) in the driver's JVM, for any that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It stays as long as results may read it, and is removed when the application ends."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def put_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Stores a small file whole, unless one of that name exists; whether it did."""
    fs, final = file_system(spark, path)
    _, temporary = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(data))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(final), none)  # without OVERWRITE: fails if it exists
        return True
    except Exception:
        fs.delete(temporary, False)
        if not fs.exists(final):
            raise
        return False


def get_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """The rows, stored once in the shared folder: later readers don't recompute them and outlive lost executors."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of stored rows that no result reads any more."""
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


def small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether the rows are at most `most`, looking no further than that."""
    return df.limit(most + 1).count() <= most


def marked(rows: DataFrame, wanted: DataFrame, key: str, words: int | None = None) -> DataFrame:
    """The rows whose key is wanted, and others whose hash has the same bit (a later join on the key drops them).

    The rows are wide, so they stay where they are and the wanted keys' bits are sent to them.
    """
    words = words or MARK_WORDS

    def spot(name: str) -> tuple:
        h = F.xxhash64(name)
        return h.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63)).cast("int")

    word, bit = spot(key)
    bits = wanted.select(word.alias("__word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("__bits"))
    return rows.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.getbit("__bits", bit) == 1).drop("__word", "__bits")


_models: dict = {}


def kept_model(of: object, make: Callable[[], object]) -> object:
    """The one model that a worker keeps between its tasks, made anew where it was made of something else."""
    if "of" not in _models or not (_models["of"] is of or isinstance(of, str) and _models["of"] == of):
        _models.clear()
        _models.update(of=of, model=make())
    return _models["model"]


def forget_model() -> None:
    """Workers outlive their queries: a task without a model drops the one that an earlier query left, and gives free memory back."""
    _models.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def map_slices(docs: DataFrame, fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], schema: str, text: str = "text", limit: int = SLICE_CHARS, model: bool = False) -> DataFrame:
    """mapInArrow with batches cut so that one call sees at most about `limit` characters, or one text.

    `fn` gets the record batch and its texts (null: empty) and returns a record batch in `schema`; `model` says that it uses `kept_model`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            forget_model()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if not batch.num_rows:
                continue
            sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
            ends = np.cumsum(sizes)
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
                part = batch.slice(start, stop - start)
                yield fn(part, [x or "" for x in column.slice(start, stop - start).to_pylist()])
                start = stop

    return docs.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
