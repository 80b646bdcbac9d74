"""The corpus pipeline: quality, near duplicates, personal data, mixture, tokens.

Each stage works on all that the one before kept and returns documents' columns; the last returns tokens. Between stages rows
are written as Parquet in the shared folder and read again. Nulls, empty and repeated rows are treated as the operators'
docstrings say; a row is a document, also where ids repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, minhash, mixing, pii, quality
from ledgerloom.llm.common import work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier doesn't reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data."""
    out = pii.pseudonymised(docs.select("doc_id", "text", "lang", "source"), pii.secret(spark), counts=False)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken."""
    return mixing.mixed_texts(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 for each row of the mix."""
    return bpe.encoded(docs, bpe.default_vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("mixture", mix_stage),
    ("tokens", token_stage),
]

#: SQL can't express shingle signatures, n-gram models or merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = work_dir(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{n}")
    return docs
