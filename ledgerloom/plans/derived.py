"""Logs and subscriptions made from the given tables, which have none: the same arithmetic as columns and as SQL.

Sightings come from `events`: the push source misses every seventh event, the poll source every eleventh; every 97th poll
decode differs; addresses and networks go by user and id. Subscriptions come from `customer`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"

_NETWORK = "case {0} % 5 when 0 then 'ethereum' when 1 then 'arbitrum' when 2 then 'base' when 3 then 'optimism' else 'polygon' end"

# Expressions that both engines read alike; the ones with hex are spelled per engine.
NETWORK = _NETWORK.format("event_id")
FLIPPED = "event_id % 50 >= 40 and cast(floor(event_id / 50) as bigint) % 10 = 0"
COMMON = f"""{NETWORK} as network,
  concat('0xAbC', lpad(cast(user_id % 40 as {{text}}), 37, '0')) as contract_address,
  concat('0xtx', lpad(cast(event_id as {{text}}), 8, '0')) as tx_hash,
  cast(event_id % 3 as bigint) as log_index,
  1000 + cast(floor(event_id / 50) as bigint) as block_number,
  concat('0xb', cast(1000 + cast(floor(event_id / 50) as bigint) as {{text}}), case when {FLIPPED} then 'f' else '' end) as block_hash,
  case when event_id % 53 = 0 then '0xabab' when event_type in ('click', 'view', 'purchase') then '{TRANSFER}' else '{APPROVAL}' end as topic0,
  cast(floor(abs(value) * 100) as bigint) as amount, event_id, user_id"""

SUBSCRIPTION_SQL = f"""select concat('sub-', lpad(cast(c_custkey as {{text}}), 8, '0')) as id, {_NETWORK.format("c_custkey")} as network,
  concat('0xABC', lpad(cast(cast(floor(c_custkey / 5) as bigint) % 48 as {{text}}), 37, '0')) as address,
  case when c_custkey % 3 <> 0 then 'erc20' else 'nested-orders' end as abi_ref,
  case when c_custkey % 2 = 0 then 1000 + c_custkey end as start_block, {{status}} as status, {{seq}} as seq from customer"""

#: DuckDB: one row per sighting.
SIGHTINGS_SQL = f"""(with base as (select {COMMON.format(text="varchar")} from events),
 seen as (select *, 'WS' as source, event_id * 2 as seq from base where event_id % 7 <> 0
   union all select *, 'POLL' as source, event_id * 2 + 1 as seq from base where event_id % 11 <> 0)
 select network, contract_address, tx_hash, log_index, block_number, block_hash, topic0,
   concat('0x', lpad(printf('%x', user_id), 64, '0')) as topic1, concat('0x', lpad(printf('%x', event_id), 64, '0')) as topic2,
   amount + case when source = 'POLL' and event_id % 97 = 0 then 7 else 0 end as amount,
   concat('0x', lpad(printf('%x', amount + case when source = 'POLL' and event_id % 97 = 0 then 7 else 0 end), 64, '0')) as data,
   source, 1700000000000 + seq as observed_at, seq from seen)"""

CHANGES_SQL = f"""({SUBSCRIPTION_SQL.format(text="varchar", status="'ACTIVE'", seq="c_custkey")}
 union all {SUBSCRIPTION_SQL.format(text="varchar", status="'REMOVED'", seq="c_custkey + 1000000000")} where c_custkey % 7 = 0)"""

CURRENT_SQL = f"""(select id, network, address, abi_ref, start_block, status from (
 select *, row_number() over (partition by id order by seq desc) as rn from {CHANGES_SQL} x) y where rn = 1)"""

FIRST_SQL = f"""(select network as n, lower(address) as a, min(id) as id, min_by(abi_ref, id) as abi_ref, min_by(status, id) as status
 from {CURRENT_SQL} c group by 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sighting, in RAW_LOG's columns. The two sources are an array that is exploded, so events are read once."""
    base = table(spark, sf_dir, "events").selectExpr(*_columns(COMMON.format(text="string")))
    seen = F.filter(F.array(F.when(F.col("event_id") % 7 != 0, F.lit("WS")), F.when(F.col("event_id") % 11 != 0, F.lit("POLL"))), lambda s: s.isNotNull())
    rows = base.withColumn("source", F.explode(seen)).withColumn("seq", F.col("event_id") * 2 + F.when(F.col("source") == "POLL", 1).otherwise(0))
    word = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    amount = F.col("amount") + F.when((F.col("source") == "POLL") & (F.col("event_id") % 97 == 0), 7).otherwise(0)
    return rows.select("network", "contract_address", "tx_hash", "log_index", "block_number", "block_hash", F.array("topic0", word(F.col("user_id")), word(F.col("event_id"))).alias("topics"), word(amount).alias("data"), "source", (F.lit(1700000000000) + F.col("seq")).alias("observed_at"), "seq")


def _columns(text: str) -> list[str]:
    """Splits a select list at its top-level commas."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def subscription_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")

    def part(status: str, seq: str, rows: DataFrame) -> DataFrame:
        sql = SUBSCRIPTION_SQL.format(text="string", status=status, seq=seq)
        return rows.selectExpr(*_columns(sql[len("select ") : sql.rindex(" from customer")]))

    return part("'ACTIVE'", "c_custkey", customers).unionByName(part("'REMOVED'", "c_custkey + 1000000000", customers.where("c_custkey % 7 = 0")))
