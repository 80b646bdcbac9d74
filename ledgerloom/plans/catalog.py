"""All queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import work_folder
from ..functions.hexes import hex_to_long, long_to_hex
from ..lifecycle.batch import COLUMNS as OUT_COLUMNS
from ..lifecycle.batch import lifecycle_batch
from ..model import event_key, progress_key
from ..operators import blocks, decode, ranges, reconcile, resolve
from ..sinks.confirmed import latest_rows
from ..sources.progress import restore
from ..sources.push import frame_kind_column
from . import derived
from .lifecycle_sql import decimal_sql, outputs_sql
from .derived import APPROVAL, CHANGES_SQL, CURRENT_SQL, FIRST_SQL, SIGHTINGS_SQL, TRANSFER, raw_logs, subscription_changes, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(subscription_changes(spark, sf_dir), ["id"], "seq").drop("seq")


def _amounts(raw: DataFrame) -> DataFrame:
    """Sightings with their amount as the decoded field."""
    return raw.withColumn("decoded_fields", F.concat(F.lit('{"value":"'), hex_to_long("data").cast("string"), F.lit('"}')))


_FIELDS = """concat('{"value":"', cast(amount as varchar), '"}')"""
_S = f"(select *, {_FIELDS} as decoded_fields from {SIGHTINGS_SQL} s0)"
_DEPTH = "case network when 'ethereum' then 12 when 'polygon' then 128 else 20 end"
_HEADS = f"(select network as hn, max(block_number) as last_block from {SIGHTINGS_SQL} h0 group by 1)"


@query(f"""select concat(network, ':', tx_hash, ':', cast(log_index as varchar)) as event_key, concat(network, ':', lower(contract_address)) as progress_key,
 network, block_number, block_hash, topic0, source, seq from {SIGHTINGS_SQL} s""")
def raw_log_projection(spark, sf_dir):
    return raw_logs(spark, sf_dir).select(event_key().alias("event_key"), progress_key().alias("progress_key"), "network", "block_number", "block_hash", F.col("topics")[0].alias("topic0"), "source", "seq")


@query("""select event_id, concat('0x', printf('%x', event_id)) as hex_id, event_id as back, cast(0 as bigint) as empty from events""")
def hex_codec_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", long_to_hex("event_id").alias("hex_id"))
    return e.select("event_id", "hex_id", hex_to_long("hex_id").alias("back"), hex_to_long(F.lit("0x")).alias("empty"))


@query(f"select id, network, address, abi_ref, start_block, status from {CURRENT_SQL} c")
def subscription_current(spark, sf_dir):
    return current(spark, sf_dir).select("id", "network", "address", "abi_ref", "start_block", "status")


@query(f"select id, network, address, status from {CURRENT_SQL} c where network = 'ethereum' and status = 'ACTIVE'")
def subscription_list_active(spark, sf_dir):
    return resolve.list_subscriptions(current(spark, sf_dir), "ethereum", "active").select("id", "network", "address", "status")


@query(f"select id, network, address, status from {CURRENT_SQL} c where id = 'sub-00000014'")
def subscription_by_id(spark, sf_dir):
    return current(spark, sf_dir).where("id = 'sub-00000014'").select("id", "network", "address", "status")


@query(f"select distinct address from {CURRENT_SQL} c where network = 'base' and status = 'ACTIVE'")
def watched_addresses(spark, sf_dir):
    from ..sources.streams import active_addresses

    return active_addresses(current(spark, sf_dir), "base")


_RESOLVED = f"""(select s.*, f.id as subscription_id, coalesce(f.abi_ref, '<unresolved>') as abi_ref, f.status as subscription_status,
 case when f.status is null then concat('no active subscription found for network=', s.network, ' address=', s.contract_address)
  when f.status <> 'ACTIVE' then concat('subscription for network=', s.network, ' address=', s.contract_address, ' is ', f.status, ', not ACTIVE') end as reason
 from {SIGHTINGS_SQL} s left join {FIRST_SQL} f on s.network = f.n and lower(s.contract_address) = f.a)"""


def _resolved(spark, sf_dir):
    return resolve.resolve(raw_logs(spark, sf_dir), current(spark, sf_dir))


@query(f"select seq, network, contract_address, subscription_id, abi_ref, subscription_status from {_RESOLVED} r")
def subscription_lookup(spark, sf_dir):
    return _resolved(spark, sf_dir).select("seq", "network", "contract_address", "subscription_id", "abi_ref", "subscription_status")


_MATCHED = f"""(select *, case when abi_ref = 'erc20' and topic0 = '{TRANSFER}' then 'Transfer' when abi_ref = 'erc20' and topic0 = '{APPROVAL}' then 'Approval' end as event_name from {_RESOLVED} r0)"""
_NO_EVENT = "case when reason is not null then reason when event_name is null then concat('no event in abiRef ''', abi_ref, ''' matches topic0 ', topic0) end"


@query(f"""select * from (select seq, tx_hash, abi_ref, {_NO_EVENT} as reason, observed_at as failed_at from {_MATCHED} m) q where reason is not null""")
def dead_letter_routing(spark, sf_dir):
    _, dead = decode.decode(raw_logs(spark, sf_dir), current(spark, sf_dir))
    return dead.select(F.col("raw_log.seq").alias("seq"), F.col("raw_log.tx_hash").alias("tx_hash"), "abi_ref", "reason", "failed_at")


_VALUES = """case when event_name = 'Transfer' then concat('{{"from":"0x', lpad(substr(topic1, 27), 40, '0'), '","to":"0x', substr(topic2, 27), '","value":"', {value}, '"}}')
 else concat('{{"owner":"0x', substr(topic1, 27), '","spender":"0x', substr(topic2, 27), '","value":"', {value}, '"}}') end"""
_DECODED = f"""(select network, tx_hash, log_index, seq, block_number, observed_at, event_name, topic0 as signature_hash, contract_address, source, {_VALUES.format(value="cast(amount as varchar)")} as decoded_fields
 from {_MATCHED} m where reason is null and event_name is not null)"""


@query(f"select seq, event_name, signature_hash, network, tx_hash, 'UNCONFIRMED' as status, source, decoded_fields from {_DECODED} d")
def decoded_routing(spark, sf_dir):
    good, _ = decode.decode(raw_logs(spark, sf_dir), current(spark, sf_dir))
    return good.select("seq", "event_name", "signature_hash", "network", "tx_hash", "status", "source", "decoded_fields")


@query(f"select seq, abi_ref, event_name, case when event_name is not null then 2 end as n_indexed from {_MATCHED} m")
def abi_event_lookup(spark, sf_dir):
    return decode.match_events(_resolved(spark, sf_dir), decode.event_table(spark)).select("seq", "abi_ref", "event_name", "n_indexed")


@query(f"select seq, network, tx_hash, log_index, concat('0x', substr(topic1, 27)) as from_address, concat('0x', substr(topic2, 27)) as to_address, amount as value from {SIGHTINGS_SQL} s")
def erc20_decode_static(spark, sf_dir):
    return decode.erc20_static(raw_logs(spark, sf_dir))


@query(f"""select seq, event_name, case when event_name is not null then topic0 end as signature_hash, case when event_name is not null then {_VALUES.format(value=decimal_sql("sha256(tx_hash)"))} end as decoded_fields,
 case when event_name is null then concat('no event in abiRef ''erc20'' matches topic0 ', topic0) end as error
 from (select *, case when topic0 = '{TRANSFER}' then 'Transfer' when topic0 = '{APPROVAL}' then 'Approval' end as event_name from {SIGHTINGS_SQL} s0) s""")
def erc20_decode_uint256(spark, sf_dir):
    """Values of the full 256 bits, through the interface decoder."""
    wide = raw_logs(spark, sf_dir).withColumn("data", F.concat(F.lit("0x"), F.sha2("tx_hash", 256)))
    d = decode.decode_udf(decode.AbiRegistry().all())("topics", "data", F.lit("erc20"))
    return wide.select("seq", d.alias("d")).select("seq", "d.*")


@query("""select event_id as seq, 'OrderFilled' as event_name, '0x883a29c585a711196682f83262b3d548f4780b7a4c3d82b9400aac59a901af79' as signature_hash,
 concat('{"maker":"', who, '","order":{"id":"', event_id, '","asset":{"token":"', who, '","delta":"-', event_id + 1, '"},"active":', case when event_id % 2 = 1 then 'true' else 'false' end, '},"amounts":["', user_id, '","', event_id, '"],"memo":"', event_type, '"}') as decoded_fields,
 cast(null as varchar) as error from (select *, concat('0x', lpad(printf('%x', cast(user_id as bigint)), 40, '0')) as who from events) e""")
def nested_orders_decode(spark, sf_dir):
    """Nested tuples, an array and a string, through the interface decoder."""
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    negative = F.concat(F.lit("f" * 48), F.lower(F.lpad(F.hex(-F.col("event_id") - 1), 16, "f")))
    e = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("bigint"))
    head = F.concat(word(F.col("event_id")), word(F.col("user_id")), negative, word(F.col("event_id") % 2), word(F.lit(192).cast("bigint")), word(F.lit(288).cast("bigint")))
    tail = F.concat(word(F.lit(2).cast("bigint")), word(F.col("user_id")), word(F.col("event_id")), word(F.length("event_type").cast("bigint")), F.rpad(F.lower(F.hex(F.col("event_type").cast("binary"))), 64, "0"))
    event = next(iter(decode.AbiRegistry().get("nested-orders").values()))
    logs = e.select(F.col("event_id").alias("seq"), F.array(F.lit(event.topic0), F.concat(F.lit("0x"), word(F.col("user_id")))).alias("topics"), F.concat(F.lit("0x"), head, tail).alias("data"))
    d = decode.decode_udf(decode.AbiRegistry().all())("topics", "data", F.lit("nested-orders"))
    return logs.select("seq", d.alias("d")).select("seq", "d.*")


_MERGED = f"""(select network, tx_hash, log_index, bool_or(source = 'WS') as seen_ws, bool_or(source = 'POLL') as seen_poll, min(observed_at) as first_seen,
 min(block_number) as block_number, coalesce(max_by(decoded_fields, seq) filter (where source = 'POLL'), min_by(decoded_fields, seq)) as decoded_fields, count(*) as n_sightings
 from {_S} s group by 1, 2, 3)"""


@query(f"select * from {_MERGED} m")
def recon_merge(spark, sf_dir):
    return reconcile.merge_sightings(_amounts(raw_logs(spark, sf_dir)))


@query(f"""select network, tx_hash, log_index, ws_fields, poll_fields, 'DIVERGENT_DECODE' as anomaly from (select network, tx_hash, log_index,
 min_by(decoded_fields, seq) filter (where source = 'WS') as ws_fields, min_by(decoded_fields, seq) filter (where source = 'POLL') as poll_fields from {_S} s group by 1, 2, 3) q where ws_fields <> poll_fields""")
def divergent_decode(spark, sf_dir):
    return reconcile.divergent(_amounts(raw_logs(spark, sf_dir)).withColumn("decoded_fields", decode.canonical_fields()))


@query(f"select network, max(block_number) as last_block from {SIGHTINGS_SQL} s group by 1")
def block_head(spark, sf_dir):
    return blocks.heads(raw_logs(spark, sf_dir))


@query(f"select network, seq, block_number, max(block_number) over (partition by network order by seq) as last_block from {SIGHTINGS_SQL} s")
def running_block_head(spark, sf_dir):
    return blocks.running_heads(raw_logs(spark, sf_dir))


@query(f"""select network, tx_hash, log_index, block_number, case when seen_poll then 'WS_GAP_SUSPECTED' else 'POLL_ONLY_CONFIRMED' end as anomaly,
 concat('seenWs=', cast(seen_ws as varchar), ' seenPoll=', cast(seen_poll as varchar), ' firstSeenAtEpochMillis=', cast(first_seen as varchar)) as details
 from {_MERGED} m join {_HEADS} h on m.network = h.hn where seen_ws <> seen_poll and last_block - block_number >= 3""")
def gap_anomalies(spark, sf_dir):
    raw = raw_logs(spark, sf_dir)
    return reconcile.gap_anomalies(reconcile.merge_sightings(_amounts(raw)), blocks.heads(raw))


_SEEN = f"(select m.*, last_block, {_DEPTH} as depth, cast(least(greatest(last_block - block_number, 0), 2147483647) as integer) as confirmations_seen from {_MERGED} m join {_HEADS} h on m.network = h.hn)"


def _seen(spark, sf_dir):
    raw = raw_logs(spark, sf_dir)
    return blocks.confirmations(reconcile.merge_sightings(_amounts(raw)), blocks.heads(raw))


@query(f"select network, tx_hash, log_index, block_number, last_block, depth, confirmations_seen from {_SEEN} q")
def confirmations_seen(spark, sf_dir):
    return _seen(spark, sf_dir).select("network", "tx_hash", "log_index", "block_number", "last_block", "depth", "confirmations_seen")


@query(f"select network, tx_hash, log_index, block_number, decoded_fields, confirmations_seen, 'CONFIRMED' as status from {_SEEN} q where confirmations_seen >= depth")
def promote_confirmed(spark, sf_dir):
    return blocks.promoted(_seen(spark, sf_dir)).select("network", "tx_hash", "log_index", "block_number", "decoded_fields", "confirmations_seen", "status")


@query(f"select network, tx_hash, log_index, block_number from {_SEEN} q where last_block - block_number > depth + 5")
def terminal_sweep(spark, sf_dir):
    return blocks.swept(_seen(spark, sf_dir)).select("network", "tx_hash", "log_index", "block_number")


_REORGS = f"""(select * from (select network, block_number, seq, block_hash, lag(block_hash) over (partition by network, block_number order by seq) as old_hash from {SIGHTINGS_SQL} s) q where old_hash <> block_hash)"""


@query(f"select network, block_number, seq, block_hash, old_hash from {_REORGS} r")
def reorg_heights(spark, sf_dir):
    return blocks.reorgs(raw_logs(spark, sf_dir))


_LIFE = outputs_sql(_DECODED)


def _outputs(spark, sf_dir):
    return lifecycle_batch(decode.decode_all(raw_logs(spark, sf_dir), current(spark, sf_dir)))


@query(f"select seq, network, tx_hash, log_index, block_number, confirmations_seen, status from {_LIFE} o where status = 'INVALIDATED'")
def invalidate_at_height(spark, sf_dir):
    """Events that were unconfirmed when their height was reorganised."""
    both = decode.decode_all(raw_logs(spark, sf_dir), current(spark, sf_dir))
    return blocks.invalidated(both).select("seq", "network", "tx_hash", "log_index", "block_number", "confirmations_seen", "status")


@query(f"""select network, block_number, block_hash from (select network, block_number, max_by(block_hash, seq) as block_hash from {SIGHTINGS_SQL} s group by 1, 2) b
 join {_HEADS} h on b.network = h.hn where block_number > last_block - ({_DEPTH} + 10)""")
def ancestry_window(spark, sf_dir):
    return blocks.ancestry_window(raw_logs(spark, sf_dir))


_STARTS = f"(select id, coalesce(case when status = 'REMOVED' then 1500 end + 1, start_block, 9000) as start, 9000 as head from {CURRENT_SQL} c)"


def _starts(spark, sf_dir):
    c = current(spark, sf_dir).withColumns({"last_block": F.when(F.col("status") == "REMOVED", F.lit(1500).cast("bigint")), "head": F.lit(9000).cast("bigint")})
    return c.select("id", ranges.start_column().alias("start"), "head")


@query(f"select id, cast(start as bigint) as start, cast(head as bigint) as head from {_STARTS} s")
def start_block_resolve(spark, sf_dir):
    return _starts(spark, sf_dir)


@query(f"""select id, cast(start as bigint) as start, cast(head as bigint) as head, cast(range_from as bigint) as range_from, cast(least(range_from + 1999, head) as bigint) as range_to
 from (select id, start, head, unnest(generate_series(cast(start as bigint), cast(head as bigint), 2000)) as range_from from {_STARTS} s where start <= head) q""")
def block_range_plan(spark, sf_dir):
    return ranges.planned(_starts(spark, sf_dir), 2000)


@query("""select event_id, last_seen, head, case when last_seen is not null and last_seen + 1 <= head then last_seen + 1 end as catchup_from,
 case when last_seen is not null and last_seen + 1 <= head then head end as catchup_to
 from (select event_id, case when event_id % 4 <> 0 then event_id end as last_seen, event_id + event_id % 3 as head from events) q""")
def catchup_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("last_seen"), (F.col("event_id") + F.col("event_id") % 3).alias("head"))
    return ranges.catchup_columns(e)


@query(f"select concat(network, ':', lower(contract_address)) as progress_key, max_by(block_number, seq) as last_block from {SIGHTINGS_SQL} s where source = 'POLL' group by 1")
def progress_restore(spark, sf_dir):
    log = raw_logs(spark, sf_dir).where("source = 'POLL'").select(progress_key().alias("progress_key"), F.col("block_number").alias("last_block"), F.col("seq").alias("log_offset"))
    return restore(log)


@query("""select event_id, case when event_id % 2 = 0 then 'NOTIFICATION' else 'ACK' end as kind from events""")
def frame_classifier(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, F.lit('{"jsonrpc":"2.0","method":"eth_subscription","params":{}}')).otherwise(F.lit('{"jsonrpc":"2.0","id":1,"result":"0x1"}'))
    return table(spark, sf_dir, "events").select("event_id", frame_kind_column(value).alias("kind"))


_UPSERT = f"(select * from (select *, row_number() over (partition by network, tx_hash, log_index order by seq desc, ord desc) as rn from {_LIFE} o where kind = 'CONFIRMATION') q where rn = 1)"


def _results(spark, sf_dir):
    return latest_rows(_outputs(spark, sf_dir).where("kind = 'CONFIRMATION'"))


@query(f"select network, tx_hash, log_index, block_number, source, status, seq from {_UPSERT} u")
def confirmed_upsert_view(spark, sf_dir):
    return _results(spark, sf_dir).select("network", "tx_hash", "log_index", "block_number", "source", "status", "seq")


@query(f"select network, tx_hash, log_index, status from {_UPSERT} u order by network, tx_hash, log_index")
def snapshot_ordered(spark, sf_dir):
    return _results(spark, sf_dir).select("network", "tx_hash", "log_index", "status").orderBy("network", "tx_hash", "log_index")


@query(f"select (select count(*) from {_UPSERT} u) as n_rows, (select count(*) from {_UPSERT} u where network = 'ethereum' and tx_hash = '0xtx00000010' and log_index = 1) as n_key")
def count_for_key(spark, sf_dir):
    hit = (F.col("network") == "ethereum") & (F.col("tx_hash") == "0xtx00000010") & (F.col("log_index") == 1)
    return _results(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count(F.when(hit, 1)).alias("n_key"))


@query(f"select * from {_LIFE} o")
def lifecycle_fold(spark, sf_dir):
    """The exact lifecycle over all sightings, decoded against their subscriptions."""
    return _outputs(spark, sf_dir)


@query(f"select * from {_LIFE} o")
def lifecycle_stream(spark, sf_dir):
    """The same as a stream: resolve, decode, lifecycle, over stored logs and subscription changes."""
    from ..abi.registry import AbiRegistry
    from ..streaming.lifecycle import lifecycle_stream as stream
    from ..streaming.lifecycle import resolve_stream

    folder = work_folder(spark, "stream")
    raw_logs(spark, sf_dir).repartition(4).write.parquet(f"{folder}/raw")
    # All changes precede the logs, so that every log sees the subscriptions as they are now.
    subscription_changes(spark, sf_dir).withColumn("seq", F.col("seq") - 10_000_000_000).write.parquet(f"{folder}/changes")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
    resolved = resolve_stream(read("raw"), read("changes"))
    decoded = decode.with_decode(resolved, AbiRegistry(), F.col("reason").isNull()).select("*", "d.event_name", "d.signature_hash", "d.decoded_fields")
    out = stream(decoded)
    done = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(*OUT_COLUMNS)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs to confirmations: look-up, decode, merge, promotion."""
    raw = raw_logs(spark, sf_dir)
    good, _ = decode.decode(raw, current(spark, sf_dir))
    return blocks.promoted(blocks.confirmations(reconcile.merge_sightings(good), blocks.heads(raw)))


__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "CHANGES_SQL", "derived"]
