"""Exact fingerprints: a wide hash of the canonical text, with bytes compared where hashes are equal.

The canonical text is NFKC-normalised, case-folded and normalised again, with runs of white space folded to one space
and none at the ends. Its fingerprint is the hexadecimal XXH3-128 of its UTF-8 bytes. Two texts are alike (1.0) when
their fingerprints are equal and so are the canonical bytes, else not (0.0).

Defined cases: a null text is an empty text; empty texts are alike and one class; repeated rows are alike and copies; a class of null doc_ids only has no class_id; rows with equal doc_id follow
one another by their text's SHA-256; null doc_ids come last; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, marked, work_dir, written

#: Rows a bucket of neighbours has, about; and the most buckets, whose limits the driver holds.
BUCKET_ROWS, MAX_BUCKETS, LEAST_BUCKETS = 1000, 50_000, 256
#: A class with over 1 / HEAVY of the repeated rows is broadcast.
HEAVY = 1000


def canonical(text: str) -> bytes:
    """The bytes that fingerprints and comparisons see."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def fingerprint(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", singles: bool = True, hash_: Callable[[bytes], str] = fingerprint) -> DataFrame:
    """One row per distinct canonical text: fingerprint, n (which of the texts with this fingerprint), canonical_sha256, class_id (least doc_id), copies.

    Rows are grouped by the fingerprint and by the canonical bytes, so texts whose hashes collide stay apart, told by their
    SHA-256 (two texts that are equal in both hashes and differ in their bytes are an error); copies are counted before the
    shuffle, which sends each task's distinct texts once, compressed. Without `singles` only texts that occur more than once
    come back: fingerprints are counted first, and only bytes of those that several rows have (and of others with the same
    bit of a bitmap of fixed size) are sent.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def prints(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([hash_(canonical(x)) for x in texts])], names=["fingerprint"])

    def whole(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        data = [canonical(x) for x in texts]
        columns = [pa.array([hash_(x) for x in data]), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array([pack(x) for x in data], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "fingerprint", "canonical_sha256", "bytes"])

    rows = map_slices(base, whole, "doc_id long, fingerprint string, canonical_sha256 string, bytes binary")
    if not singles:
        again = map_slices(base.select("text"), prints, "fingerprint string").groupBy("fingerprint").count().where("count > 1").select("fingerprint")
        rows = marked(rows, written(again, f"{work_dir(docs.sparkSession, 'fingerprints')}/again"), "fingerprint")
    groups = rows.groupBy("fingerprint", "canonical_sha256", "bytes").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    groups = groups.groupBy("fingerprint", "canonical_sha256").agg(F.count("*").alias("texts"), F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"))
    copies = F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts have the same XXH3-128 and SHA-256")).cast("long")).otherwise(F.col("copies"))
    number = F.row_number().over(Window.partitionBy("fingerprint").orderBy("canonical_sha256"))
    groups = groups.select("fingerprint", (number - 1).alias("n"), "canonical_sha256", "class_id", copies.alias("copies"))
    return groups if singles else groups.where("copies > 1")


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", canonical_sha256: bool = False) -> DataFrame:
    """op9's contract: each text with an edit of it, whose last half comes from the next document.

    Documents are dealt by doc_id into buckets of consecutive ids, whose limits are quantiles over all ids; a bucket is
    sorted and read in one pass, a text at a time. The documents that begin a bucket are dealt a second time, to the bucket
    before, where they come last. Texts are shuffled once, compressed. `canonical_sha256` adds that hash as a last column.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = base.select("doc_id")
    rows = ids.agg(F.count("*").alias("n")).first()["n"]
    many = min(MAX_BUCKETS, max(LEAST_BUCKETS, rows // BUCKET_ROWS))
    cuts = ids.select(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 10 * many).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)  # bucket 0 has the highest ids; null ids have the last one
    last = len(cuts) + 1

    def bucket(values: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return np.where(missing, last, len(cuts) - np.searchsorted(cuts, values, side="right"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int | None] = {}
        for batch in batches:
            column = batch.column(0)
            missing = np.asarray(column.is_null())
            values = np.asarray(column.fill_null(0), dtype=np.int64)
            where = bucket(values, missing)
            for b in np.unique(where):
                here = values[where == b].max()
                best[int(b)] = None if b == last else int(max(best.get(int(b), here), here))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["bucket", "head"])

    first = {r["bucket"]: r["head"] for r in ids.mapInArrow(heads, "bucket int, head long").groupBy("bucket").agg(F.max("head").alias("head")).collect()}
    held = sorted(first)
    before = {b: held[i - 1] for i, b in enumerate(held)}  # the first bucket's head follows the last bucket

    def deal(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        column = batch.column(0)
        missing = np.asarray(column.is_null())
        values = np.asarray(column.fill_null(0), dtype=np.int64)
        rows = []
        for text_, b, value, none in zip(texts, bucket(values, missing).tolist(), values.tolist(), missing.tolist(), strict=True):
            data = text_.encode("utf-8", "surrogatepass")
            key, body = hashlib.sha256(data).digest()[:16], pack(data)
            rows.append((b, False, none, -1 - value, key, None if none else value, body))
            if none or first[b] == value:
                rows.append((before[b], True, none, -1 - value, key, None if none else value, body))
        kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "after", "missing", "place", "key", "doc_id", "body"])

    dealt = map_slices(base, deal, "bucket int, after boolean, missing boolean, place long, key binary, doc_id long, body binary")
    dealt = dealt.repartition(max(1, min(len(held) // 2, 4 * many)), "bucket").sortWithinPartitions("bucket", "after", "missing", "place", "key")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            b, after, ids_, bodies = (batch.column(i) for i in (0, 1, 5, 6))
            for i in range(batch.num_rows):
                yield b[i].as_py(), after[i].as_py(), ids_[i].as_py(), unpack(bodies[i].as_py()).decode("utf-8", "surrogatepass")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, next text): a bucket's rows in order, then the next bucket's head."""
        row = None
        for b, after, id_, text_ in rows_of(batches):
            if row is not None:  # a bucket that ends without a head after it is the only one and has no null ids
                yield row[1], row[2], text_ if row[0] == b else row[2]
            row = None if after else (b, id_, text_)
        if row is not None:
            yield row[1], row[2], row[2]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    if canonical_sha256:
        names, kinds = [*names, "canonical_sha256"], (*kinds, pa.string())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = [], (None, b"", "")
        for id_, own, following in pairs(batches):
            take = len(own) // 2
            edited = own[: len(own) - take] + following[:take]
            mine = known[1:] if known[0] == own else (canonical(own), None)
            if mine[1] is None:
                mine = (mine[0], fingerprint(mine[0]))
            data = [mine[0], canonical(edited), canonical(following)]
            prints = [mine[1], fingerprint(data[1]), fingerprint(data[2])]
            known = (following, data[2], prints[2])
            alike = [float(prints[0] == p and data[0] == d) for p, d in zip(prints[1:], data[1:], strict=True)]
            key = [hashlib.sha256(data[0]).hexdigest()] if canonical_sha256 else []
            out.append((id_, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), prints[0], prints[1], *alike, *key))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(compare, schema + (", canonical_sha256 string" if canonical_sha256 else ""))


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`neighbours`, with class_id (least doc_id of the rows whose canonical bytes are equal) and copies (how many they are).

    Classes with over 1 / HEAVY of all repeated rows are fewer than HEAVY and are broadcast; their rows are spread by doc_id
    and edited text in the join with the other classes, so that none of its keys has a larger share.
    """
    found = written(exact_classes(docs, doc_id, text, singles=False).drop("n"), f"{work_dir(docs.sparkSession, 'classes')}/repeated")
    limit = (found.agg(F.sum("copies").alias("rows")).first()["rows"] or 0) // HEAVY
    on = ["fingerprint", "canonical_sha256"]
    heavy = found.where(F.col("copies") > limit).withColumnsRenamed({"class_id": "heavy_class", "copies": "heavy_copies"}) if limit else None
    rows = neighbours(docs, doc_id, text, canonical_sha256=True)
    if heavy is not None:
        rows = rows.join(F.broadcast(heavy), on, "left")
        spread = F.concat_ws(":", F.lit(""), "doc_id", "edited_sha256")  # no digest has a colon
        rows = rows.withColumn("canonical_sha256", F.when(F.col("heavy_copies").isNull(), F.col("canonical_sha256")).otherwise(spread))
    else:
        rows = rows.select("*", F.lit(None).cast("long").alias("heavy_class"), F.lit(None).cast("long").alias("heavy_copies"))
    rows = rows.join(found.where(F.col("copies") <= limit) if limit else found, on, "left")
    single = F.when(F.coalesce("heavy_copies", "copies").isNull(), F.col("doc_id"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("heavy_class", "class_id", single).alias("class_id"), F.coalesce("heavy_copies", "copies", F.lit(1)).cast("long").alias("copies"),
    )


def op9_exact_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
