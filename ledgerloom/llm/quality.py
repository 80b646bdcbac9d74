"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over characters of any script (lower-cased; digits are one symbol, white space another), in n-grams of up to ORDER that
are known by 64-bit hashes. Trusted text is all labelled documents of quality 1 of one half of them, whole (limits come from all
of the other half). Counts are kept and joined in Spark, dealt by n-gram: highest-order counts are occurrences, lower ones
continuations; three discounts an order come from counts of counts; an n-gram's probability joins its context's total and the
probability of its ending. The model stays a table: a row an n-gram, with its probability and, as a context, its back-off weight.

Scoring joins the documents with that table by shards of n-grams. Documents are dealt, in compressed chunks, into blocks of about
BLOCK_CHARS characters. A block's distinct n-grams are asked for once, as one sorted list a shard; a shard's task holds its part of the
model and answers each list in order; the answers go back to the block, which reads its texts against them. So texts move once, no
task or driver holds the whole model, and an n-gram that all documents have is asked for once a block.

A document is rejected when its perplexity, taken together with PRIOR_CHARS characters of the trusted texts' average (short
texts prove little), is above its language's limit: the QUANTILE of the same over all held-out trusted documents of that language (a language with fewer than LEAST_TRUSTED of them, or none given, has the limit over all).

Defined cases: null and empty texts have perplexity 1 and are kept, having nothing to reject; a null language is a language
of its own; without trusted documents nothing is rejected (perplexity null); repeated rows give repeated rows; labels that
repeat or contradict count as trusted if any says quality 1; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, marked, removed, small, work_dir, written

ORDER = 5
QUANTILE, LEAST_TRUSTED, PRIOR_CHARS = 0.995, 30, 200
FALLBACK = (0.5, 1.0, 1.5)
#: Characters of a chunk of documents, and of a block, which is what a task reads against its answers.
CHUNK_CHARS, BLOCK_CHARS = 1_000_000, 32_000_000
#: Model rows that a shard's task holds, about; the least number of shards.
SHARD_ROWS, LEAST_SHARDS = 1_000_000, 64
BOUNDARY = "\U0010ffff"
_STEP, _ROOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)
#: The context of single characters, as a row of the model.
EMPTY = int(_ROOT.astype(np.int64))


def parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(texts with the ORDER - 1 characters before them, each one's row), cut so that a turn has about CHUNK_CHARS characters."""
    lead, held, rows, size = BOUNDARY * (ORDER - 1), [], [], 0
    for row, text in enumerate(texts):
        body = lead + text.lower()
        for at in range(ORDER - 1, len(body), CHUNK_CHARS):
            held.append(body[at - ORDER + 1 : at + CHUNK_CHARS])
            rows.append(row)
            size += len(held[-1])
            if size >= CHUNK_CHARS:
                yield held, rows
                held, rows, size = [], [], 0
    if held:
        yield held, rows


def _extended(context: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hashes of n-grams from those of their contexts and their last characters."""
    x = context * _STEP
    x += points
    x += np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def points_of(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 48) & (points <= 57)] = 48
    points[(points >= 9) & (points <= 13)] = 32
    return points


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the places of characters and, before each text's first, of the end of its lead; how many of these each text has)."""
    sizes = np.array([len(x) for x in texts])
    used = np.ones(sizes.sum(), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER - 2):
        used[starts + k] = False
    return np.flatnonzero(used), sizes - (ORDER - 2)


def windows(points: np.ndarray) -> Iterator[np.ndarray]:
    """By order n, the hashes of all n-grams: that which ends at place i is number i - n + 1."""
    before = np.full(len(points) + 1, _ROOT)
    for n in range(1, ORDER + 1):
        before = _extended(before[: len(points) - n + 1], points[n - 1 :])
        yield before


def chain_names() -> list[str]:
    """An n-gram's hash and those of its parts: g5, its context c5, its ending g4, that one's context c4, and so on."""
    return [f"{x}{n}" for n in range(ORDER, 0, -1) for x in "gc"]


def _counted(sample: DataFrame) -> DataFrame:
    """g5, c5, g4, c4, ..., n: the distinct highest n-grams of the texts with their counts.

    N-grams are added up by their characters (21 bits each, in two longs); their parts' hashes are made after that.
    """

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = [(np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),)]
        for held, _ in parts(texts):
            points = points_of(held)
            used, sizes = places(held)
            used = np.delete(used, np.cumsum(sizes) - sizes)
            *_, top = windows(points)
            _, first, n = np.unique(top[used - ORDER + 1], return_index=True, return_counts=True)
            c = [points[used[first] - k] for k in range(ORDER)]
            found.append((c[3] | c[4] << np.uint64(21), c[0] | c[1] << np.uint64(21) | c[2] << np.uint64(42), n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["high", "low", "n"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            mask = np.uint64((1 << 21) - 1)
            c = [high >> np.uint64(21), high & mask, low >> np.uint64(42), low >> np.uint64(21) & mask, low & mask]
            columns = []
            for n in range(ORDER, 0, -1):
                context = np.full(len(low), _ROOT)
                for k in range(ORDER - n, ORDER - 1):
                    context = _extended(context, c[k])
                columns += [_extended(context, c[-1]), context]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), batch.column(2)], names=[*chain_names(), "n"])

    rows = map_slices(sample.select("text"), of, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))
    return rows.mapInArrow(chained, ", ".join(f"{x} long" for x in [*chain_names(), "n"]))


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, from how many n-grams have the counts 1 to 4; FALLBACK where they give none above 0."""
    if all(of.get(k) for k in (1, 2, 3, 4)):
        y = of[1] / (of[1] + 2 * of[2])
        found = tuple(k - (k + 1) * y * of[k + 1] / of[k] for k in (1, 2, 3))
        if all(d > 0 for d in found):
            return found
    return FALLBACK


def fit(sample: DataFrame, folder: str) -> tuple[DataFrame, float] | None:
    """(model: g, p, gamma; the probability of a character never seen) of the trusted texts; None if they have no characters."""
    names = chain_names()
    level = written(_counted(sample), f"{folder}/counts{ORDER}")
    if level.isEmpty():
        return None
    levels = {ORDER: level.withColumnRenamed("n", "c")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: before how many characters the ending occurs
        chain = names[2 * (ORDER - n) :]
        levels[n] = written(levels[n + 1].groupBy(chain[0]).agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in chain[1:])), f"{folder}/counts{n}")
    floor, below, model = 1.0 / (levels[1].count() + 1), None, []
    for n in range(1, ORDER + 1):
        level = levels[n]
        of = dict(level.where("c <= 4").groupBy("c").count().collect())  # at most four rows
        d1, d2, d3 = discounts(of)
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        level = level.select(F.col(f"g{n}").alias("g"), F.col(f"c{n}").alias("context"), (F.col(f"g{n - 1}") if n > 1 else F.lit(EMPTY)).alias("ending"), "c", taken.alias("d"))
        contexts = level.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        joined = level.join(contexts, "context")
        joined = joined.withColumn("low", F.lit(floor)) if below is None else joined.join(below, "ending")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("low")
        known = written(joined.select("g", p.alias("p")), f"{folder}/p{n}")
        nothing = F.lit(None).cast("double")
        model += [known.select("g", "p", nothing.alias("gamma")), contexts.select(F.col("context").alias("g"), nothing.alias("p"), "gamma")]
        below = known.select(F.col("g").alias("ending"), F.col("p").alias("low"))
    both = model[0]
    for part in model[1:]:
        both = both.union(part)
    return written(both.groupBy("g").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), f"{folder}/model"), floor


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; sorted hashes go by their differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _distinct(chunks: Iterator[list[str]]) -> np.ndarray:
    """The hashes of all windows that scoring the texts looks up, sorted."""
    found = [np.array([_ROOT])]
    for texts in chunks:
        for held, _ in parts(texts):
            used, _ = places(held)
            found += [np.unique(h[used - n if n < ORDER - 1 else used[used >= n] - n]) for n, h in enumerate(windows(points_of(held)))]
        if sum(map(len, found)) > 4 * CHUNK_CHARS:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found))


def _chunked(docs: DataFrame, blocks: int) -> DataFrame:
    """block, body: the rows as compressed Arrow batches of about CHUNK_CHARS characters, dealt in turn."""

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=6).compress(sink.getvalue())], pa.binary())], names=["body"])

    return map_slices(docs, of, "body binary", limit=CHUNK_CHARS).select(F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(blocks)).alias("block"), "body")


def _opened(body: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all().combine_chunks()
    return table.to_batches()[0]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so that lists by shard, one after the other, are sorted."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _asked(dealt: DataFrame, shards: int) -> DataFrame:
    """shard, block, list: what each block asks of each shard."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(block: int, bodies: list[bytes]) -> pa.RecordBatch:
            keys = _distinct(_texts(_opened(body)) for body in bodies)
            cuts = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
            rows = [(s, block, _pack(np.diff(keys[a:b], prepend=np.uint64(0)))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "list"])

        now, bodies = None, []
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and bodies:
                    yield asked(now, bodies)
                    bodies = []
                now = block
                bodies.append(body)
        if bodies:
            yield asked(now, bodies)

    return dealt.sortWithinPartitions("block").mapInArrow(of, "shard long, block long, list binary")


def _answered(asked: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """block, shard, list, p, gamma: probabilities and back-off weights (NaN for none) in the lists' order."""
    # The same range of the unsigned hash as _shard's, from its signed value.
    high = F.shiftrightunsigned("g", 32)
    rows = model.select(F.shiftrightunsigned(high * F.lit(shards), 32).alias("shard"), F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("list"), "g", F.col("p").cast("float").alias("p"), F.col("gamma").cast("float").alias("gamma"))
    none = lambda t: F.lit(None).cast(t)
    lists = asked.select("shard", "block", "list", none("long").alias("g"), none("float").alias("p"), none("float").alias("gamma"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, p, gamma = None, [], None, None, None
        for batch in batches:
            shards_, blocks = (np.asarray(batch.column(i)) for i in (0, 1))
            model_rows = np.flatnonzero(blocks < 0)
            for s in np.unique(shards_[model_rows]):  # a shard's rows of the model come before its lists
                if s != now:
                    now, held, keys = s, [], None
                at = pa.array(model_rows[shards_[model_rows] == s])
                held.append([np.asarray(batch.column(3).take(at)).view(np.uint64), *(np.asarray(batch.column(i).take(at).fill_null(float("nan"))) for i in (4, 5))])
                if (blocks[shards_ == s] >= 0).any():
                    keys, p, gamma, held = *_sorted(held), []
                yield from _answers(batch, np.flatnonzero((shards_ == s) & (blocks >= 0)), keys, p, gamma)
            for s in np.setdiff1d(shards_, shards_[model_rows]):
                if s != now:
                    now, held, keys = s, [], None
                if held or keys is None:
                    keys, p, gamma, held = *_sorted(held), []
                yield from _answers(batch, np.flatnonzero(shards_ == s), keys, p, gamma)

    both = rows.unionByName(lists).repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "block")
    return both.mapInArrow(of, "block long, shard long, list binary, p binary, gamma binary")


def _sorted(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.float32)
    keys, p, gamma = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    return keys[order], p[order].astype(np.float32), gamma[order].astype(np.float32)


def _answers(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray, p: np.ndarray, gamma: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in rows.tolist():
        wanted = np.cumsum(_unpack(batch.column(2)[i].as_py(), np.uint64), dtype=np.uint64)
        nothing = np.full(len(wanted), np.nan, np.float32)
        values = (nothing, nothing)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            values = (np.where(keys[at] == wanted, x[at], np.float32("nan")) for x in (p, gamma))
        yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), *(pa.array([_pack(x)], pa.binary()) for x in values)], names=["block", "shard", "list", "p", "gamma"])


class Places:
    """Where hashes stand in a sorted list that has them all: by the first place of their leading bits, and on from there."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, min(24, int(len(keys)).bit_length() + 2))
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        wrong = np.flatnonzero(self.keys[at] != wanted)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != wanted[wrong]]
        return at


def scores(texts: list[str], table: Places, p: np.ndarray, gamma: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of log probabilities, and how many characters it has."""
    total, many = np.zeros(len(texts)), np.zeros(len(texts))
    start = floor * float(gamma[table.of(np.array([_ROOT]))[0]])
    weights = np.where(np.isnan(gamma), np.float32(1), gamma)
    seen = ~np.isnan(p)
    for held, rows in parts(texts):
        used, sizes = places(held)
        heads = np.cumsum(sizes) - sizes
        now, before = None, None
        for n, hashes in enumerate(windows(points_of(held)), 1):
            if n == ORDER:  # contexts end with the order before it, and heads have no n-gram of this one
                real = np.delete(used, heads)
                at = table.of(hashes[real - n + 1])
            else:
                every = table.of(hashes[used - n + 1])
                at = np.delete(every, heads)
            lower = start if n == 1 else now * np.delete(weights[before], np.cumsum(sizes) - 1)
            now = np.where(seen[at], p[at], lower).astype(np.float64)
            before = every
        row = np.repeat(rows, sizes - 1)
        total += np.bincount(row, np.log(np.maximum(now, 1e-300)), len(texts))
        many += np.bincount(row, minlength=len(texts))
    return total, many


def perplexities(docs: DataFrame, model: DataFrame, floor: float, text: bool = False) -> DataFrame:
    """The given columns (with the text or without), perplexity (6 digits) and length (in characters)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-chars // BLOCK_CHARS)), max(LEAST_SHARDS, -(-model.count() // SHARD_ROWS))
    tasks = int(min(max(8, 4 * blocks), 1 << 16))  # so many that few blocks share one
    # Both the questions and the scores read this one shuffle of the texts.
    dealt = _chunked(docs, blocks).repartition(tasks, "block")
    answers = _answered(_asked(dealt, shards), model, shards)
    kept = [c for c in docs.columns if text or c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", perplexity double, length long"
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        lists, p, gamma = (np.concatenate([_unpack(x, kind) if name != "list" else np.cumsum(_unpack(x, kind), dtype=kind) for x in right.column(name).to_pylist()]) for name, kind in (("list", np.uint64), ("p", np.float32), ("gamma", np.float32)))
        table, out = Places(lists), []
        for body in left.column("body"):
            batch = _opened(body.as_py())
            texts = _texts(batch)
            sums, many = scores(texts, table, p, gamma, floor)
            perplexity = np.round(np.exp(-sums / np.maximum(many, 1)), 6)
            lengths = [len(x) for x in texts]
            out.append(pa.Table.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(perplexity), pa.array(lengths, pa.int64())], names=[*kept, "perplexity", "length"]))
        return pa.concat_tables(out)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of, schema)


def _scored(docs: DataFrame, model: DataFrame, floor: float, folder: str, text: bool = False) -> DataFrame:
    """`perplexities`, stored; the folder's model and the tables it was made from are removed."""
    scored = written(perplexities(docs, model, floor, text), f"{folder}/scored")
    removed(docs.sparkSession, f"{folder}/model", *(f"{folder}/{name}{n}" for name in ("counts", "p") for n in range(1, ORDER + 1)))
    return scored


#: The half of the trusted documents that limits come from; the model is of the other.
HELD_OUT = "pmod(xxhash64(doc_id, 5L), 2) = 0"


def train(docs: DataFrame, labels: DataFrame, folder: str) -> tuple[DataFrame, float] | None:
    """The model of the whole trusted texts of the fitting half; None if there are none."""
    chosen = _good(labels).where(f"not ({HELD_OUT})")
    # The chosen ids' bits are sent to the texts, so that few others are shuffled for the join that decides.
    half = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"text != '' and not ({HELD_OUT})")
    # An inner join: a semi-join would be pushed below the marks. The ids are distinct.
    sample = marked(half, chosen, "doc_id").join(chosen.hint("merge"), "doc_id").select("text")
    return fit(sample, folder)


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _judged(scored: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    """The rows with evidence, threshold and is_kept; limits come from all held-out trusted documents and are joined by language."""
    good = scored.select("doc_id", "lang", "perplexity", "length").join(_good(labels).where(HELD_OUT), "doc_id", "left_semi")
    usual = good.agg(F.avg(F.log("perplexity"))).first()[0] or 0.0
    evidence = F.exp((F.log("perplexity") * F.col("length") + usual * PRIOR_CHARS) / (F.col("length") + PRIOR_CHARS))
    good = good.withColumn("evidence", evidence)
    q = F.percentile_approx("evidence", quantile, 10000).alias("q")
    overall = good.agg(q).first()["q"]
    limits = good.groupBy("lang").agg(q, F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("of_lang"), F.col("q").alias("own"))
    fits = F.col("lang").eqNullSafe(F.col("of_lang"))
    if small(limits):
        joined = scored.join(F.broadcast(limits), fits, "left")
    else:  # a language may have most rows: they are salted, and the limits repeated
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "perplexity"), F.lit(64)).cast("int"))
        joined = salted.join(limits.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), fits & (F.col("salt") == F.col("of_salt")), "left").drop("salt", "of_salt")
    joined = joined.withColumn("evidence", evidence).withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double"))).drop("of_lang", "own")
    return joined.withColumn("is_kept", F.coalesce(F.col("evidence") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per input row: doc_id, lang, perplexity, evidence, threshold, is_kept."""
    folder = work_dir(docs.sparkSession, "quality")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    model = train(base, labels, folder)
    if model is None:
        nothing = F.lit(None).cast("double")
        return base.select("doc_id", "lang", nothing.alias("perplexity"), nothing.alias("evidence"), nothing.alias("threshold"), F.lit(True).alias("is_kept"))
    scored = _scored(base, *model, folder)
    return _judged(scored, labels, quantile).select("doc_id", "lang", "perplexity", "evidence", "threshold", "is_kept")


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of documents that `classify` keeps, as they are."""
    folder = work_dir(docs.sparkSession, "quality")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    model = train(named, labels, folder)
    if model is None:
        return named
    scored = _scored(named, *model, folder, text=True)
    return _judged(scored, labels, quantile).where("is_kept").select("doc_id", "text", "lang", "source", "n_chars")


def op7_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
