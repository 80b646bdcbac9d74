"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks per shard, then seeded selection.

Sources' targets share a budget by weight; a target above `most` times its source's size stops there and the rest is
shared again. The budget is counted in blocks of BLOCK words. Blocks go to sources, and each source's to its shards, by
the highest quotients words / (2 x blocks + 1), none above `most` times its blocks. A shard is a seeded part of a
source's documents, in seeded order; its quota takes all of its blocks as often as that goes, and the rest is a
run of blocks from a seeded start, around the end if need be. So whole documents are taken but for the two at a run's
ends, and what a document gives follows from its place in the shard alone.

Sources and shards (at most MAX_SHARDS) are summed before the driver sees them; documents never are.

Defined cases: a null text has size 0; null sources are one source, the last; a null doc_id is ordered first in its
shard; equal rows may swap places, which does not change the result's rows; a source without words has target 0;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_dir, written

BLOCK = 16
SHARD_WORDS = 1 << 17
MAX_SHARDS = 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Each source's target (exact). Sources by code point, null last, weigh as `weights`, repeating."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def sainte_lague(votes: list, seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), ties to the first, none above its cap."""
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v))
    total = sum(votes)
    if not seats or not total:
        return [0] * len(votes)

    def at(divisor: Fraction) -> list[int]:
        return [min(c, int(Fraction(v) / divisor + Fraction(1, 2))) for v, c in zip(votes, caps, strict=True)]

    low, high = Fraction(total, 4 * seats * (len(votes) + 1)), Fraction(2 * total + 1)  # many seats; few
    while sum(at(low)) < seats:
        low /= 2
    for _ in range(60):
        middle = (low + high) / 2
        middle = Fraction(round(middle * (1 << 40)), 1 << 40) or middle
        if sum(at(middle)) <= seats:
            high = middle
        else:
            low = middle
    got = at(high)
    heap = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if v and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    return got


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 7) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, passes (whole copies), spans (further words taken, as [from, to))."""
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, work_dir(spark, "mix"))
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes, weights, share, most)
    unit = max(SHARD_WORDS, -(-sum(sizes.values()) // MAX_SHARDS))
    plan = spark.createDataFrame([(i, s, sizes[s], float(goal[s]), -(-sizes[s] // unit) or 1) for i, s in enumerate(order)], "sid int, s string, source_size long, target double, shards int")
    placed = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")).cast("int"))
    sums = sorted((r["sid"], r["shard"], r["words"]) for r in placed.groupBy("sid", "shard").agg(F.sum("size").alias("words")).collect())
    by_source: dict[int, list] = {}
    for sid, shard, words in sums:
        by_source.setdefault(sid, []).append((shard, words))
    blocks = sainte_lague([goal[s] for s in order], round(sum(goal.values(), Fraction(0)) / BLOCK), [most * sum(-(-w // BLOCK) for _, w in by_source.get(i, [])) for i in range(len(order))])
    rows = []
    for sid, shards in by_source.items():
        quotas = sainte_lague([w for _, w in shards], blocks[sid], [most * -(-w // BLOCK) for _, w in shards])
        rows += [(sid, shard, words, -(-words // BLOCK), quota) for (shard, words), quota in zip(shards, quotas, strict=True)]
    quota = spark.createDataFrame(rows, "qsid int, qshard int, words long, blocks long, quota long")
    placed = placed.join(F.broadcast(quota), (F.col("sid") == F.col("qsid")) & (F.col("shard") == F.col("qshard")))
    line = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(line)
    placed = placed.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))
    n = F.greatest("blocks", F.lit(1))
    placed = placed.withColumn("passes", F.floor(F.col("quota") / n)).withColumn("extra", F.col("quota") % n).withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), n))
    stop = F.col("start") + F.col("extra")
    runs = [(F.col("start") * BLOCK, F.least(stop * BLOCK, F.col("words"))), (F.lit(0).cast("long"), (stop - n) * BLOCK)]
    spans = F.filter(F.array(*[F.struct((F.greatest(a, F.col("begin")) - F.col("begin")).alias("from"), (F.least(b, F.col("end")) - F.col("begin")).alias("to")) for a, b in runs]), lambda x: x["to"] > x["from"])
    placed = placed.withColumn("spans", spans)
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["to"] - x["from"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "spans")


def mixed_texts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: documents' columns, a row for each whole pass and one with the words of the further spans.

    The spans' words are joined by spaces (only the texts at the ends of a shard's run are cut). Rows are told apart
    for the join by their place in a stored copy of the input, so repeated rows and clashing ids stay apart.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("line", F.monotonically_increasing_id())
    named = written(named, work_dir(spark, "mixin"))
    plan = mix(named.select("line", "text", "source"), doc_id="line", seed=seed).select(F.col("doc_id").alias("line"), "size", "passes", "spans")
    whole = F.size("spans") == 1
    whole = whole & (F.col("spans")[0]["from"] == 0) & (F.col("spans")[0]["to"] == F.col("size"))
    full = named.join(plan.select("line", "size", "passes", "spans"), "line")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.concat_ws(" ", F.transform("spans", lambda x: F.array_join(F.slice(words, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), " ")))
    extra = F.when(F.size("spans") == 0, F.array().cast("array<string>")).when(whole, F.array("text")).otherwise(F.array(cut))
    empty = (F.col("size") == 0)
    texts = F.when(empty, F.array("text")).otherwise(F.concat(F.array_repeat("text", F.col("passes").cast("int")), extra))
    return full.select("doc_id", F.explode(texts).alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op5_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
