"""Stream and batch readers of stored topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RAW_LOG, parsed


def read_files(spark: SparkSession, path: str, schema: str = RAW_LOG, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str = RAW_LOG, offsets_a_trigger: int | None = None) -> DataFrame:
    """A stream of JSON records; needs Spark's Kafka connector. seq is the record's offset (a network's records share a partition)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if offsets_a_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_a_trigger)
    records = reader.load().select(F.col("value").cast("string").alias("value"), F.col("offset"))
    columns = parsed(records, schema).columns
    return records.select(F.from_json("value", schema).alias("r"), "offset").select(*[F.col("offset").alias("seq") if c == "seq" else F.col(f"r.{c}") for c in columns])


def active_addresses(subscriptions: DataFrame, network: str) -> DataFrame:
    """The distinct addresses to watch in a network."""
    return subscriptions.where((F.col("network") == network) & (F.col("status") == "ACTIVE")).select("address").distinct()
