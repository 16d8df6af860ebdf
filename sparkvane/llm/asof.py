"""Tolerant as-of join: each click gets the latest order of its key at or before it, if that is recent enough.

Orders of one key and time are collapsed into one group, which keeps the preferred order and their
number. Clicks and groups are put together, sorted by key and time into ranges, and a running count of
the groups gives each group its dense ordinal and each click the ordinal of the group that it follows. Clicks
and groups then meet by an equi-join on key and ordinal.

A key may hold any share of the rows: ranges cut a key's rows by time, and clicks of one time by
their id. The count runs within a range; the last group of the ranges before, with its ordinal, is repeated
at the head of each range that has rows of its key, so that count and join stay within ranges (the range is part of the join's
key). Nothing is broadcast or gathered but a row for each key and range.

Defined cases. Copies of a click id count once; of copies that differ the one with the earliest time and
the least key stays, null last; clicks without id are one click. An order row counts as often as it comes. Of orders of one
key and time the smaller priority wins, then the larger sale_id, then the larger total, null losing each
time. A null key or time never matches. A null id has no hash: its time isn't floored, and no second order
results. No clicks, no rows; no orders, all unmatched. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.llm.common import read, written

HOUR_US = 3_600_000_000
TOLERANCE_US = 240 * HOUR_US
#: Ranges for each shuffle partition: a hot key's ranges are dealt out by hash, more evenly if they are more.
RANGES = 2


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        since = F.col(name) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def crc(value: Column) -> Column:
    """The unsigned crc32 of a number's decimal digits."""
    return F.crc32(value.cast("string"))


def floored(at: Column, h: Column, to: int = HOUR_US) -> Column:
    """`at`, for odd h cut to a multiple of `to`."""
    return F.when(h % 2 == 1, at - F.pmod(at, F.lit(to))).otherwise(at)


def best_of(orders: DataFrame, prefer: list[Column], payload: list[str]) -> DataFrame:
    """Tie-collapsed groups: key, at, payload of the order that comes first by `prefer`, n_tied."""
    ranked = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)], *payload)
    found = orders.where("key is not null and at is not null").groupBy("key", "at").agg(F.min(ranked).alias("best"), F.count("*").alias("n_tied"))
    return found.select("key", "at", *[F.col(f"best.{c}").alias(c) for c in payload], "n_tied")


def as_of(clicks: DataFrame, groups: DataFrame, tolerance: int) -> DataFrame:
    """clicks (id, key, at) with the columns of their group, null where there is none, and `order_at`, its time.

    groups has one row for a key and time; all times are whole numbers.
    """
    payload = [c for c in groups.columns if c not in ("key", "at")]
    none = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in payload]
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    union = groups.select("key", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), *payload)
    union = union.unionByName(clicks.where(known).select("key", "at", F.lit(1).alias("kind"), "id", *none))
    ranges = RANGES * int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(union.repartitionByRange(ranges, "key", "at", "kind", "id").withColumn("part", F.spark_partition_id()))

    group = F.when(F.col("kind") == 0, F.struct("at", *payload))
    parts = dealt.groupBy("key", "part").agg(F.count_if(F.col("kind") == 0).alias("n"), F.max(group).alias("latest"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.sum("n").over(earlier).alias("weight"), F.last("latest", ignorenulls=True).over(earlier).alias("latest"))
    carried = parts.where("weight > 0").select("part", "key", "latest.at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), *[F.col(f"latest.{c}").alias(c) for c in payload], "weight")
    rows = dealt.withColumn("weight", (1 - F.col("kind")).cast("long")).unionByName(carried)

    ordinal = F.sum("weight").over(Window.partitionBy("part", "key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    asking = rows.select("part", "key", "at", "kind", "id", "weight").withColumn("ordinal", ordinal).where("kind = 1").drop("kind", "weight")
    numbered = rows.where("kind = 0").withColumn("ordinal", ordinal)
    numbered = numbered.select(F.col("part").alias("g_part"), F.col("key").alias("g_key"), F.col("ordinal").alias("g_ordinal"), F.col("at").alias("order_at"), *payload)
    near = (F.col("part") == F.col("g_part")) & (F.col("key") == F.col("g_key")) & (F.col("ordinal") == F.col("g_ordinal")) & (F.col("at") - F.col("order_at") <= tolerance)
    matched = asking.join(numbered.hint("merge"), near, "left").select("id", "key", "at", "order_at", *payload)
    return matched.unionByName(clicks.where(~known).select("id", "key", "at", F.lit(None).cast("long").alias("order_at"), *none))


def op11_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click of `clicks` with its latest order of at most 240 hours; unmatched clicks, and those without client or time, have n_tied 0 and nulls. No clicks, no rows."""
    seen, sold = read(spark, sf_dir, "clicks"), read(spark, sf_dir, "sales")
    h = crc(F.col("click_id"))
    clicks = seen.select("click_id", "client_id", micros(seen, "ts").alias("ts"))
    clicks = clicks.groupBy("click_id").agg(F.min(F.struct(F.isnull("ts"), "ts", F.isnull("client_id"), "client_id")).alias("c"))
    clicks = clicks.select(F.col("click_id").alias("id"), F.col("c.client_id").alias("key"), floored(F.col("c.ts"), h).alias("at"))

    h = crc(F.col("sale_id"))
    orders = sold.select(F.col("client_id").alias("key"), floored(micros(sold, "sold_at"), h).alias("at"), "sale_id", F.col("priority").cast("long").alias("priority"), F.floor(100 * F.col("total") + 0.5).cast("long").alias("total_cents"), h.alias("h"))
    second = F.when(F.col("h") % 3 != 0, F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority")))
    orders = orders.select("key", "at", "total_cents", F.explode(F.array_compact(F.array(F.struct("sale_id", "priority"), second))).alias("o")).select("key", "at", "o.*", "total_cents")
    # the complement of a number falls as the number rises
    prefer = [F.isnull("priority"), F.col("priority"), F.isnull("sale_id"), F.bitwise_not("sale_id"), F.isnull("total_cents"), F.bitwise_not("total_cents")]
    found = as_of(clicks, best_of(orders, prefer, ["sale_id", "total_cents"]), TOLERANCE_US)
    return found.select(
        F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("at").alias("ts_us"), "sale_id", (F.col("at") - F.col("order_at")).alias("lag_us"),
        "total_cents", F.coalesce("n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )


#: crc32 bit by bit, of decimal digits; used by the SQL of other queries too.
_CRC = """xor(4294967295, list_reduce(
  list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(cast({0} as varchar), '.'), lambda c: cast(ascii(c) as bigint))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""


def crc_sql(value: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a number's decimal digits."""
    return _CRC.format(value)


OP11_SQL = f"""
with click as (
  select distinct click_id, client_id, epoch_us(ts) as us, {crc_sql("click_id")} as h from clicks),
asked as (
  select click_id, client_id, case when h % 2 = 1 then us - us % {HOUR_US} else us end as us from click),
sale as (
  select sale_id, client_id, cast(priority as bigint) as priority, cast(floor(100 * total + 0.5) as bigint) as cents, epoch_us(sold_at) as us,
    {crc_sql("sale_id")} as h from sales),
once as (
  select sale_id, client_id, priority, cents, case when h % 2 = 1 then us - us % {HOUR_US} else us end as us, h from sale),
twice as (
  select sale_id, client_id, priority, cents, us from once
  union all select -1 - sale_id, client_id, 6 - priority, cents, us from once where h % 3 <> 0),
best as (
  select *, count(*) over (partition by client_id, us) as n_tied from twice where client_id is not null and us is not null
  qualify row_number() over (partition by client_id, us order by priority nulls last, sale_id desc nulls last, cents desc nulls last) = 1),
met as (
  select a.click_id, a.client_id, a.us as ts_us, b.sale_id, a.us - b.us as lag_us, b.cents, b.n_tied, coalesce(a.us - b.us <= {TOLERANCE_US}, false) as near
  from asked a asof left join best b on a.client_id = b.client_id and a.us >= b.us)
select click_id, client_id, ts_us, case when near then sale_id end as sale_id, case when near then lag_us end as lag_us,
  case when near then cents end as total_cents, case when near then n_tied else 0 end as n_tied
from met
"""
