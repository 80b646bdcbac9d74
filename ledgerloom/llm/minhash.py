"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles (words: lower-cased, split at white space; fewer than five
words make one shingle of them all; no words make the empty multiset). A signature component is the earliest
arrival over all (shingle, weight level) pairs of exponential clocks, so two components agree with the probability
of the weighted Jaccard similarity. Weights are discretised to whole counts and clocks come from one Poisson
process per shingle and dyadic weight block ([0,1), [1,2), [2,4), ...): each arrival draws a position in its block
and a component, arrivals above the text's own weight are passed over, and a process stops as soon as it cannot
lower any component. Bands of components give candidate buckets; candidates are verified by the overlap of their
multisets; classes are the connected components of verified links.

Defined cases: a null text is an empty text; all empty texts are exact copies of one another and of nothing else;
repeated rows and ties share a class; a class is named by its smallest doc_id (null if it has none); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, marked, mix, removed, small, work_dir, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
COMPONENTS = BANDS * ROWS
#: Buckets up to this size compare all their pairs; larger ones compare with one pivot a round.
SMALL_BUCKET = 12
#: Rounds of pivots for large buckets before what they still mix is joined by rare shingles.
PIVOT_ROUNDS = 2
#: Slots of the shingle counts that order that join: bounded, whatever the input.
SLOTS = 1 << 18
#: Links that the driver unites itself: two numbers each.
SMALL_LINKS = 100_000
#: Words of 64 bits in the parity sketch that rules out pairs of that join.
SKETCH = 8

_GOLDEN, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SKETCH = [f"s{i}" for i in range(SKETCH)]
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def normal(text: str) -> str:
    """Lower-cased words joined by single spaces."""
    return " ".join(text.lower().split())


def shingles(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each normal text's shingles, in order, repeats included."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10))
    # A word's hash: its bytes' values times powers of an odd base, by differences of running sums.
    forward = _powers(len(data), _BASE)
    sums = np.cumsum(_TABLE[data] * forward, dtype=np.uint64)
    starts = np.concatenate([[0], stops[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    word = mix((sums[stops - 1] - before) * _powers(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)))[starts]) if len(stops) else np.empty(0, np.uint64)
    filled = stops > starts  # an empty text has one empty word
    last = np.flatnonzero(data[stops] == 10)
    ends = np.cumsum(filled)[last]
    word = word[filled]
    out, begin = [], 0
    n = len(word) - WORDS + 1
    if n > 0:
        all_ = np.zeros(n, np.uint64)
        for k in range(WORDS):
            all_ = mix(all_ + word[k : k + n] + _GOLDEN * np.uint64(k + 1))
    for end in ends.tolist():
        if end - begin >= WORDS:
            out.append(all_[begin : end - WORDS + 1])
        elif end > begin:
            short = np.zeros(1, np.uint64)
            for k in range(end - begin):
                short = mix(short + word[begin + k : begin + k + 1] + _GOLDEN * np.uint64(k + 1))
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
        begin = end
    return out


def signatures(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """float64 arrival times (docs x components) of weighted elements; `doc` gives each element's row."""
    if components & (components - 1) or components > 2048:
        raise ValueError("components must be a power of two up to 2048")
    first = np.full(docs * components, np.inf)
    low, block, live = 0, 0, np.arange(len(keys))
    while len(live):
        width = max(1, low)
        seed, owner, time = mix(keys[live] + _GOLDEN * np.uint64(block + 1)), doc[live], np.zeros(len(live))
        top = weights[live].astype(np.float64) if low else None
        step = 0
        while len(seed):
            step += 1
            draw = mix(seed + np.uint64(int(_GOLDEN) * step & MASK))
            time = time - np.log1p((draw >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) / width
            at = owner * components + (draw & np.uint64(components - 1)).astype(np.int64)
            if top is None:
                np.minimum.at(first, at, time)
            else:
                ok = low + np.floor((mix(draw ^ _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width) < top
                np.minimum.at(first, at[ok], time[ok])
            go = time < first.reshape(docs, components).max(axis=1)[owner]
            seed, owner, time, top = seed[go], owner[go], time[go], None if top is None else top[go]
        low += width
        block += 1
        live = live[weights[live] > low]
    return first.reshape(docs, components)


def _multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, weights, owner, ordered = [], [], [], []
    for i, bag in enumerate(shingles(texts)):
        ordered.append(bag)
        if len(bag):
            k, w = np.unique(bag, return_counts=True)
            keys.append(k), weights.append(w), owner.append(np.full(len(k), i, np.int64))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), ordered
    return np.concatenate(keys), np.concatenate(weights), np.concatenate(owner), ordered


def _bands(first: np.ndarray) -> np.ndarray:
    bits = mix(first.view(np.uint64)).reshape(len(first), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (len(first), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out + bits[:, :, r])
    return out


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of the word sequence, shingle count n, 16 band keys, and the sorted multiset as 32-bit hashes."""

    def of(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        texts = [normal(x) for x in texts]
        keys, weights, owner, bags = _multisets(texts)
        bands = _bands(signatures(keys, weights, owner, len(texts))).view(np.int64)
        digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]
        flat = pa.ListArray.from_arrays(np.arange(0, len(texts) * BANDS + 1, BANDS, dtype=np.int32), bands.reshape(-1))
        bag = [np.sort((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in bags]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([len(x) for x in bags], pa.int64()), flat, pa.array(bag, pa.binary())], names=["doc_id", "digest", "n", "bands", "bag"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), of, "doc_id long, digest binary, n long, bands array<long>, bag binary", limit=2_000_000)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    keys, at = np.unique(both, return_inverse=True)
    cx, cy = np.bincount(at[: len(x)], minlength=len(keys)), np.bincount(at[len(x) :], minlength=len(keys))
    return float(np.minimum(cx, cy).sum() / np.maximum(cx, cy).sum())


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""

    def of(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            near = [overlap(x[i].as_py(), y[i].as_py()) >= similarity for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    full = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def _centred(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (u, v) with u's m. Both are stored, so each side is dealt for this join alone and Spark can split a node of many edges."""
    return edges.join(least, "u")


def united(links: pa.Table) -> pa.Table:
    """`components` of a table (u, v)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in zip(links.column("u").to_pylist(), links.column("v").to_pylist(), strict=True):
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
        parent.setdefault(u, u)
    nodes = [x for x in parent if find(x) != x]
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Up to SMALL_LINKS links are united by the driver. More alternate large-star and small-star steps until they are stars; each step is
    written to the folder, and removed once the next is.
    """
    spark = links.sparkSession
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    if small(now, SMALL_LINKS):
        return spark.createDataFrame(united(now.toArrow()), "node long, root long")
    seen, step = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, step = tuple(state), step + 1
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{folder}/{step}-least")
        large = _centred(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{folder}/{step}-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/{step}-low")
        inner = _centred(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(low.select("u", F.col("m").alias("v")).union(inner).distinct(), f"{folder}/{step}")
        removed(spark, f"{folder}/{step - 1}", *(f"{folder}/{step}-{name}" for name in ("least", "large", "low")))


def merged(roots: DataFrame | None, links: DataFrame, folder: str) -> DataFrame:
    """(node, root) with more links: only the roots that these join go through the steps of `components`."""
    if roots is None:
        return components(links, folder)
    ends = links
    for name in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"of_{name}")), name, "left")
    above = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), folder)
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root")).union(above)


def _small_pairs(members: DataFrame, sizes: DataFrame, most: int, similarity: float) -> DataFrame:
    inside = members.join(sizes.where(F.col("size") <= most).select("key"), "key")
    other = inside.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    return inside.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("rb")) & (F.least("n", "nb") >= F.lit(similarity) * F.greatest("n", "nb"))).select(F.col("node").alias("a"), "b")


def _pivot_pairs(members: DataFrame, sizes: DataFrame, most: int, similarity: float) -> DataFrame:
    hub = members.select(F.col("node").alias("hub"), F.col("n").alias("nh"), F.col("root").alias("rh"), F.col("key"))
    hubs = sizes.where(F.col("size") > most).select("key", "hub").join(hub, ["key", "hub"])
    return members.join(hubs, "key").where((F.col("node") != F.col("hub")) & (F.col("root") != F.col("rh")) & (F.least("n", "nh") >= F.lit(similarity) * F.greatest("n", "nh"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _sizes(members: DataFrame, mask: int) -> DataFrame:
    """Buckets that hold more than one class, with their size and one member (the least under a bijective mask)."""
    least = F.min(F.col("node").bitwiseXOR(F.lit(mask)))
    return members.groupBy("key").agg(F.count("*").alias("size"), least.bitwiseXOR(F.lit(mask)).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "size", "hub")


def _elements(bag: bytes) -> np.ndarray:
    """64-bit keys of a sorted multiset's elements; repeats of a hash are numbered, so multisets are compared as sets."""
    x = np.frombuffer(bag, np.uint32).astype(np.uint64)
    at = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), at, 0))
    return mix(x + _GOLDEN * (at - first + 1).astype(np.uint64))


def _slot_counts(bags: DataFrame) -> np.ndarray:
    """How many elements fall in each slot, over all the bags."""

    def of(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for bag in batch.column(0):
                counts += np.bincount((_elements(bag.as_py()) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in bags.select("bag").mapInArrow(of, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SLOTS rows
        out[r["slot"]] = r["n"]
    return out


def _rare_members(bags: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(key, node, n, at, sketch) for the elements of which two bags that overlap enough must share one.

    All bags list their elements in one order, those of the emptiest slots first; each overlaps the other in at least
    similarity x n of its own elements, so its first n - ceil(similarity x n) + 1 have one in common with the other's.
    `at` is the element's place in that order. The sketch has the parity of the bag's elements in each of 64 x SKETCH
    hash places: two bags' sketches differ in no more places than the elements that only one of them has.
    """
    shared = bags.sparkSession.sparkContext.broadcast(counts)

    def of(batches):
        counts, found, size = shared.value, [], 0
        names = ["key", "node", "n", "at", *_SKETCH]
        for batch in batches:
            for node, bag in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = _elements(bag.as_py())
                n = len(keys)
                order = np.lexsort((keys, counts[(keys & np.uint64(SLOTS - 1)).astype(np.int64)]))
                rare = keys[order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]].view(np.int64)
                parity = np.bincount((keys >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
                words = np.packbits(parity).view(np.int64)
                found.append((rare, *(np.full(len(rare), x, np.int64) for x in (node, n)), np.arange(len(rare)), *(np.full(len(rare), x, np.int64) for x in words)))
                size += len(rare)
                if size >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return bags.select("node", "bag").mapInArrow(of, ", ".join(f"{name} long" for name in ["key", "node", "n", "at", *_SKETCH]))


def _mixed_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """The pairs of a bucket that are in different classes: whoever is not of its largest class, with all others.

    Two bags with n and m elements are similar enough if they share s / (1 + s) x (n + m). A pair is passed over where the
    shared element stands too late for that many to follow, or the sketches differ in more places than that leaves.
    """
    counts = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = counts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("most.root").alias("main"))
    mixed = members.join(main, "key")
    few = mixed.where("root <> main").select("key", *(F.col(name).alias(f"other_{name}") for name in ["node", "n", "root", "at", *_SKETCH]))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("other_n")) - 1e-6)
    differ = sum((F.bit_count(F.col(name).bitwiseXOR(F.col(f"other_{name}"))) for name in _SKETCH), F.lit(0))
    fits = (F.col("at") <= F.col("n") - need) & (F.col("other_at") <= F.col("other_n") - need) & (differ <= F.col("n") + F.col("other_n") - 2 * need)
    pairs = mixed.join(few, (mixed["key"] == few["key"]) & (F.col("root") != F.col("other_root")) & fits)
    return pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size (rows in the class), is_kept.

    is_kept marks one row of each class: its smallest doc_id (among equal ids, one). Exact copies are folded into
    one node before banding, so a text that makes up a third of all rows costs one node. A bucket of up to
    SMALL_BUCKET nodes compares all its pairs; a larger one compares its members with a pivot, a few rounds over,
    always skipping pairs that are already in one class. The members of those that then still mix classes are joined
    exactly, by their rarest shingles, so that no link between classes is lost, whatever a bucket's size.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "minhash")
    rows = written(sketch(docs, doc_id, text).withColumn("line", F.monotonically_increasing_id()), f"{folder}/rows")
    # A node is a distinct text, named by the first row that has it.
    copies = rows.groupBy("digest", "n").agg(F.min("line").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = written(copies, f"{folder}/nodes")
    kept = rows.select(F.col("line").alias("node"), "n", "bands").join(nodes.where("n > 0").select("node"), "node")
    bags = rows.select(F.col("line").alias("node"), "bag")
    members = written(kept.select("node", "n", F.posexplode("bands").alias("band", "key")).select("key", "node", "n"), f"{folder}/members")
    shared = members.join(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "key")
    members = written(shared, f"{folder}/shared")
    removed(spark, f"{folder}/members")
    roots, tried = None, None
    for round_ in range(PIVOT_ROUNDS + 1):
        if round_ == 0:
            rooted = members.withColumn("root", F.col("node"))
        else:
            rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            rooted = written(rooted, f"{folder}/rooted-{round_}")
        sizes = _sizes(rooted, (0, -1, 0x5555555555555555, 0x3333333333333333)[round_ % 4])
        if round_ < PIVOT_ROUNDS:
            pairs = _pivot_pairs(rooted, sizes, SMALL_BUCKET, similarity)
            if round_ == 0:
                pairs = pairs.union(_small_pairs(rooted, sizes, SMALL_BUCKET, similarity))
        else:
            left = rooted.join(sizes.where(F.col("size") > SMALL_BUCKET).select("key"), "key").select("node", "root").distinct()
            left = written(left, f"{folder}/left")
            rest = written(marked(bags, left, "node"), f"{folder}/left-bags")
            rare = _rare_members(rest, _slot_counts(rest), similarity).join(left, "node")
            pairs = _mixed_pairs(written(rare, f"{folder}/left-members"), similarity)
            removed(spark, f"{folder}/left-bags")
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{folder}/pairs-{round_}")
        if round_ and pairs.isEmpty():
            if round_ == PIVOT_ROUNDS or sizes.where(F.col("size") > SMALL_BUCKET).isEmpty():
                break
            continue
        compared = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        wanted = written(marked(bags, compared, "node"), f"{folder}/bags-{round_}")
        found = written(verified(pairs, wanted, similarity), f"{folder}/links-{round_}")
        tried = pairs if tried is None else tried.union(pairs)
        removed(spark, f"{folder}/bags-{round_}")
        if roots is not None and found.isEmpty():
            continue
        roots = written(merged(roots, found, f"{folder}/stars-{round_}"), f"{folder}/roots-{round_}")
        removed(spark, f"{folder}/stars-{round_}")
    owner = nodes.join(roots, "node", "left").select("digest", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    classes = owner.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = owner.join(classes, "root").select("digest", "root", "class_id", "class_size")
    placed = rows.select("doc_id", "digest", "line").join(named, "digest")
    placed = written(placed.select("line", "root", "doc_id", "class_id", "class_size"), f"{folder}/placed")
    rounds = [f"{name}-{n}" for n in range(PIVOT_ROUNDS + 1) for name in ("rooted", "pairs", "links", "roots")]
    removed(spark, *(f"{folder}/{name}" for name in ["rows", "nodes", "shared", "left", "left-members", *rounds]))
    one = placed.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("line").alias("line")).select("line", F.lit(True).alias("kept"))
    return placed.join(one, "line", "left").select("doc_id", "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("is_kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents, one of each class of near duplicates: that of the least doc_id (null last), of equal ones the first as stored.

    Rows are numbered and stored once, so that repeated ids stay apart and no later reading numbers them otherwise.
    """
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").withColumn("line", F.monotonically_increasing_id())
    numbered = written(numbered, f"{work_dir(docs.sparkSession, 'numbered')}/rows")
    classes = near_duplicates(numbered.select("line", "text"), "line", "text", similarity).select(F.col("doc_id").alias("line"), "class_id")
    ranked = classes.join(numbered.select("line", "doc_id"), "line")
    best = ranked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")).alias("b")).select(F.col("b.line").alias("line"))
    return numbered.join(best, "line", "left_semi").drop("line")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
