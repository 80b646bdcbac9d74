"""The exact lifecycle over stored logs, with only the block track in order.

The clock of a network is the height after each row. It changes at few rows, the first ones of a block under a hash: these
alone are folded in order, a task a network. Everything else goes by keys and heights:

1. `track`: rows are reduced to the first of each (network, epoch, height, hash), where an epoch ends whenever a height shows another
   hash than before; `core.track_block` folds them into the rows at which the clock moves or a height is reorganised.
2. `clocked`: each row gets the clock after it and the row that follows it, by windows over buckets of seq (of `width`).
3. `dues`: for each height when the clock came to stand depth, gap and sweep blocks above it, and when it was reorganised.
4. `settled`: rows are joined with their height's dues and dealt by event key; a key's few rows are folded as they stream by.

A key's memory is its open sighting and confirmation; a busy network is as many tasks as it has keys and buckets. `batch.fold_in_order`
takes every row of a network through `core.step` instead and gives the same rows; where a gap is larger than the depth
it is used, since events may then be seeded again from a sighting that is older than their confirmation.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_NETWORKS, SWEEP_BLOCKS, NetworkParams, params_for, with_params
from ..functions.folders import work_folder
from ..model import LIFECYCLE_OUT
from ..operators.blocks import seq_width
from .core import DIVERGED, Event, NetworkState, Options, Sighting, confirmations_seen, gap_details, merge, one_sided, track_block

TRACK = "network string, seq bigint, at bigint, before bigint, last bigint, height bigint, is_reorg boolean"


def _before_buckets(per_bucket: DataFrame, value: str, combine) -> DataFrame:
    """Adds `carry`: the value combined over a network's earlier buckets."""
    return per_bucket.withColumn("carry", combine(F.col(value)).over(Window.partitionBy("network").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop(value)


def track(rows: DataFrame, width: int, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS) -> DataFrame:
    """The rows at which a network's clock moves or a height is reorganised: TRACK."""
    base = rows.select("network", "seq", "block_number", "block_hash", "observed_at")
    heights = base.groupBy("network", "block_number").agg(F.min("block_hash").alias("a"), F.max("block_hash").alias("b")).where("a <> b").select("network", "block_number")
    before = F.lag("block_hash").over(Window.partitionBy("network", "block_number").orderBy("seq"))
    flips = base.join(heights, ["network", "block_number"]).withColumn("old", before).where("old <> block_hash").select("network", "seq", F.lit(1).alias("flip"))
    # The number of flips up to each row: within its bucket and in the buckets before.
    bucket = F.floor(F.col("seq") / width).alias("bucket")
    per_bucket = flips.select("network", bucket, "flip").groupBy("network", "bucket").agg(F.sum("flip").alias("n"))
    every = base.select("network", bucket).distinct().join(per_bucket, ["network", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    carried = _before_buckets(every, "n", F.sum)
    marked = base.select("*", bucket, F.lit(0).alias("flip")).unionByName(flips.select("network", "seq", F.lit(None).cast("bigint").alias("block_number"), F.lit(None).cast("string").alias("block_hash"), F.lit(None).cast("bigint").alias("observed_at"), bucket, "flip"))
    inside = F.sum("flip").over(Window.partitionBy("network", "bucket").orderBy("seq", F.desc("flip")).rowsBetween(Window.unboundedPreceding, 0))
    epochs = marked.withColumn("inside", inside).where("flip = 0").join(carried, ["network", "bucket"]).withColumn("epoch", F.col("inside") + F.coalesce("carry", F.lit(0)))
    first = epochs.groupBy("network", "epoch", "block_number", "block_hash").agg(F.min(F.struct("seq", "observed_at")).alias("f"))
    ordered = first.select("network", "f.seq", "f.observed_at", "block_number", "block_hash").repartition("network").sortWithinPartitions("network", "seq")
    networks = dict(networks)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, NetworkState()
        for batch in batches:
            out = []
            for network, seq, at, height, hash_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if network != name:
                    name, state = network, NetworkState()
                was = state.last
                reorg = track_block(state, height, hash_, params_for(networks, network).confirmation_depth)
                if reorg is not None or state.last != was:
                    out.append((network, seq, at, was, state.last, height, reorg is not None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), *[pa.int64()] * 5, pa.bool_()), strict=True)], names=[c.split()[0] for c in TRACK.split(", ")])

    return ordered.mapInArrow(fold, TRACK)


def clocked(rows: DataFrame, moves: DataFrame, width: int) -> DataFrame:
    """The rows with `last`, the clock after them, and the next row of the network: next_seq, next_last."""
    bucket = F.floor(F.col("seq") / width).alias("bucket")
    names = rows.columns
    both = rows.select("*", bucket, F.lit(1).alias("is_row"), F.lit(None).cast("bigint").alias("moved")).unionByName(moves.select("network", "seq", bucket, F.lit(0).alias("is_row"), F.col("last").alias("moved")), allowMissingColumns=True)
    here = Window.partitionBy("network", "bucket").orderBy("seq", "is_row")
    carried = _before_buckets(both.groupBy("network", "bucket").agg(F.max_by("moved", F.when(F.col("moved").isNotNull(), F.col("seq"))).alias("n")), "n", lambda c: F.last(c, ignorenulls=True))
    timed = both.withColumn("inside", F.last("moved", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))).where("is_row = 1")
    timed = timed.join(carried, ["network", "bucket"]).withColumn("last", F.coalesce("inside", "carry"))
    following = F.lead(F.struct("seq", "last")).over(Window.partitionBy("network", "bucket").orderBy("seq"))
    heads = timed.groupBy("network", "bucket").agg(F.min(F.struct("seq", "last")).alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("network").orderBy("bucket"))).select("network", "bucket", "after")
    out = timed.withColumn("next", following).join(heads, ["network", "bucket"]).withColumn("next", F.coalesce("next", "after"))
    return out.select(*names, "last", F.col("next.seq").alias("next_seq"), F.col("next.last").alias("next_last"))


def dues(moves: DataFrame, followed: DataFrame, networks: Mapping[str, NetworkParams], options: Options) -> DataFrame:
    """network, block_number, due: (kind, seq, at, last, next_seq, next_last) in order of seq. Kinds: g and c and s when the clock
    comes to stand gap, depth and sweep blocks above the height, r when it is reorganised (last is then the clock before)."""
    known = with_params(moves.join(followed.select("network", "seq", "next_seq", "next_last"), ["network", "seq"]), networks)
    up = known.where("last > before").withColumn("height", F.explode(F.sequence(F.col("before") + 1, F.col("last"))))
    when = lambda kind, last="last": F.struct(F.lit(kind).alias("kind"), "seq", "at", F.col(last).alias("last"), "next_seq", "next_last").alias("due")
    distance = {"g": F.col("gap"), "c": F.col("depth"), "s": F.col("depth") + SWEEP_BLOCKS + 1}
    each = F.array(*[F.struct((F.col("height") - d).alias("block_number"), when(k)) for k, d in distance.items()])
    rose = up.select("network", F.explode(each).alias("x")).select("network", "x.block_number", "x.due")
    fell = known.where("is_reorg")
    if options.invalidate_descendants:  # what stands above is gone too; nothing open stands above the clock
        fell = fell.withColumn("height", F.explode(F.sequence(F.col("height"), F.greatest("height", "before"))))
    return rose.unionByName(fell.select("network", F.col("height").alias("block_number"), when("r", "before"))).groupBy("network", "block_number").agg(F.sort_array(F.collect_list(F.struct("due.seq", "due.kind", "due.at", "due.last", "due.next_seq", "due.next_last"))).alias("due"))


@dataclass
class _Open:
    """An event with its height's dues by kind: lists of seq, and of (seq, at, last, next_seq, next_last)."""

    event: Event
    due: dict[str, tuple[list, list]]
    polled: bool = False
    status: str = "UNCONFIRMED"
    since: int = 0
    when: tuple | None = None  # (seq, at, last, next_seq, next_last) of what comes next: confirmation or sweep

    def after(self, kind: str, seq: int) -> tuple | None:
        at, all_ = self.due.get(kind, ((), ()))
        i = bisect_right(at, seq)
        return all_[i] if i < len(at) else None


class _Key:
    """The states of one event key, between its rows; `out` gets (seq, phase, fields)."""

    def __init__(self, params: NetworkParams, options: Options, out: list):
        self.params, self.options, self.out = params, options, out
        self.sighting: Sighting | None = None
        self.seen_due: dict = {}
        self.seen_when: tuple | None = None
        self.held: _Open | None = None

    def _swept(self, c: _Open, end: tuple) -> tuple | None:
        height = c.event.block_number + self.params.confirmation_depth + SWEEP_BLOCKS + 1
        if c.status == "CONFIRMED" and end[2] >= height and end[3] is not None and end[4] >= height:
            return (end[3],)
        return c.after("s", end[0])

    def advance(self, seq: int | None) -> None:
        """What happens before row `seq` (None: ever), and reorganisations at it."""
        early = lambda t: t is not None and (seq is None or t[0] < seq)
        if self.sighting and early(self.seen_when):
            self._missed(self.seen_when)
        c = self.held
        if c and c.status == "UNCONFIRMED":
            gone = c.after("r", c.since)
            if gone and (seq is None or gone[0] <= seq) and not (c.when and c.when[0] < gone[0]):
                c.status = "INVALIDATED"
                self.out.append((gone[0], 0, ("CONFIRMATION", c.event, c.status, confirmations_seen(gone[2], c.event.block_number), None, None, gone[1])))
                c.when = self._swept(c, gone)
            elif early(c.when):
                self._confirm(c.when)
        if c and c.status != "UNCONFIRMED" and early(c.when):
            self.held = None

    def _confirm(self, t: tuple) -> None:
        c = self.held
        c.status = "CONFIRMED"
        self.out.append((t[0], 2, ("CONFIRMATION", c.event, c.status, confirmations_seen(t[2], c.event.block_number), None, None, t[1])))
        c.when = self._swept(c, t)

    def _missed(self, t: tuple) -> None:
        s, self.sighting = self.sighting, None
        kind = one_sided(s, t[2], self.params.reconciliation_gap)
        self.out.append((t[0], 3, ("ANOMALY", None, None, None, kind, gap_details(s), t[1])))

    def row(self, now: tuple, event: Event, due: dict) -> None:
        """now: (seq, at, last, next_seq, next_last)."""
        seq, at, last = now[:3]
        self.advance(seq)
        merged, differs = merge(self.sighting, event, at)
        if differs:
            self.out.append((seq, 1, ("ANOMALY", None, None, None, "DIVERGENT_DECODE", DIVERGED, at)))
        if merged.event is event:
            self.seen_due = due
        carried = self.seen_due
        self.sighting = None if merged.seen_ws and merged.seen_poll else merged
        c = self.held
        if c is None or c.status == "UNCONFIRMED":
            c = self.held = _Open(merged.event, carried, merged.seen_poll or bool(c and c.polled), since=seq)
            height = c.event.block_number + self.params.confirmation_depth
            if not self.options.require_poll or c.polled:
                c.when = now if last >= height else c.after("c", seq)
            if c.when is now:
                self._confirm(now)
        elif c.when and c.when[0] == seq:  # terminal until this row: swept by it, after its event was passed over
            self.held = None
        if self.sighting:
            s = _Open(merged.event, carried)
            self.seen_when = now if last - merged.event.block_number >= self.params.reconciliation_gap else s.after("g", seq)
            if self.seen_when is now:
                self._missed(now)


_FIELDS = ("event_name", "signature_hash", "contract_address", "block_number", "source", "decoded_fields")
_OUT = [(c.strip().split(" ")[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.strip().split(" ")[1]]) for c in LIFECYCLE_OUT.split(",")]


def settled(events: DataFrame, networks: Mapping[str, NetworkParams], options: Options) -> DataFrame:
    """LIFECYCLE_OUT, with the phase of its row in `ord`."""
    networks = dict(networks)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, key, out = None, None, []

        def rows() -> list[tuple]:
            done = [(f[0], *name, seq, phase, *((f[1].event_name, f[1].signature_hash, f[1].contract_address, f[1].block_number) if f[1] else (None,) * 4), f[2], *((f[1].source, f[1].decoded_fields) if f[1] else (None, None)), *f[3:]) for seq, phase, f in out]
            out.clear()
            return done

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])

        for batch in batches:
            found = []
            for r in batch.to_pylist():
                now = (r["network"], r["tx_hash"], r["log_index"])
                if now != name:
                    if key:
                        key.advance(None)
                        found += rows()
                    name, key = now, _Key(params_for(networks, now[0]), options, out)
                due: dict[str, tuple[list, list]] = {}
                for d in r["due"] or ():
                    at, all_ = due.setdefault(d["kind"], ([], []))
                    at.append(d["seq"])
                    all_.append((d["seq"], d["at"], d["last"], d["next_seq"], d["next_last"]))
                key.row((r["seq"], r["observed_at"], r["last"], r["next_seq"], r["next_last"]), Event(*(r[f] for f in _FIELDS)), due)
                found += rows()
            if found:
                yield batch_of(found)
        if key:
            key.advance(None)
            found = rows()
            if found:
                yield batch_of(found)

    dealt = events.repartition("network", "tx_hash", "log_index").sortWithinPartitions("network", "tx_hash", "log_index", "seq")
    return dealt.mapInArrow(fold, LIFECYCLE_OUT)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The rows, written once in the shared folder and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lifecycle_sets(decoded: DataFrame, networks: Mapping[str, NetworkParams] = DEFAULT_NETWORKS, options: Options = Options()) -> DataFrame:
    """Confirmations and anomalies with the seq and order in which a stream would give them. seq must be unique in a network."""
    width = seq_width(decoded)
    folder = work_folder(decoded.sparkSession, "lifecycle")
    moves = _stored(track(decoded, width, networks), f"{folder}/moves")
    followed = _stored(clocked(decoded, moves, width), f"{folder}/rows")
    events = followed.where("event_name is not null").join(dues(moves, followed, networks, options), ["network", "block_number"], "left")
    out = settled(events, networks, options)
    place: Column = F.row_number().over(Window.partitionBy("network", "seq").orderBy("ord", "tx_hash", "log_index")) - 1
    return out.withColumn("ord", place.cast("int"))
