"""Sharding by weighted rendezvous hashing. DataFrame operations only.

Every record key and shard number give a uniform u in (0, 1), of the first 52 bits of an MD5; the record goes
to the shard with the least -ln(u) / weight. Another shard moves only the records that it wins, and each shard holds
a share of the keys in proportion to its weight. The law is `key`.

Defined cases. A null key is a key like any other, the empty text's. A null text has 0 bytes, the size 8 and the
checksum 0 of no bytes. Repeated rows go to one shard and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import SMALL, columns, fresh, read, running, text_bytes

#: Parts of a shard within which slots are numbered: three hexadecimal digits.
PARTS = 4096
BYTES_A_RECORD = 8


def _digest(key: Column, what: str | int, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(key.cast("string"), F.lit(""))))


def _score(key: Column, shard: int, weight: float, seed: int) -> Column:
    u = (F.conv(F.substring(_digest(key, shard, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard of a key among len(weights) shards."""
    return F.array_min(F.array(*[F.struct(_score(key, i, w, seed).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def grown_shard_of(key: Column, shard: Column, weights: list[float], added: float, seed: int = 0) -> Column:
    """The shard of a key once a shard of weight `added` joins: the one it has, or the new one."""
    best = F.least(*[_score(key, i, w, seed) for i, w in enumerate(weights)], F.lit(float("inf")))
    return F.when(_score(key, len(weights), added, seed) < best, F.lit(len(weights))).otherwise(shard)


def with_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", added: float = 1.0, seed: int = 0) -> DataFrame:
    """docs and the columns size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 in each shard, in the order of a hash of the key. Columns of docs
    with one of these names are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if key in made or text in made:
        raise ValueError(f"key and text must not be one of {made}")
    held = docs.select(*columns(docs, *made))
    at, part, one = (fresh(held, n) for n in ("at", "part", "one"))
    body = F.coalesce(F.col(text), F.lit(""))
    held = held.withColumns({
        "size": text_bytes(F.col(text)) + BYTES_A_RECORD,
        "text_crc32": F.crc32(body).cast("long"),
        "law": F.lit("key"),
        "shard": shard_of(F.col(key), weights, seed).cast("int"),
        at: _digest(F.col(key), "slot", seed),
    }).withColumns({
        "grown_shard": grown_shard_of(F.col(key), F.col("shard"), weights, added, seed).cast("int"),
        part: F.conv(F.substring(at, 1, 3), 16, 10).cast("int"),
        one: F.lit(1).cast("long"),
    })
    out = running(held, ["shard"], part, [at, key, "text_crc32", "size"], one, "slot", few=len(weights) * PARTS <= SMALL)
    return out.withColumn("slot", F.col("slot") - 1).drop(at, part, one)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 equal shards."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_shards(docs, [1.0] * 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: DuckDB has no CRC-32: its table is made by rule and run over the bytes.
OP9_SQL = """
with recursive step as (
  select n, 0 as k, n as c from (select unnest(range(256)) as n)
  union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc as (select list(c order by n) as t from step where k = 8),
held as (
  select doc_id, coalesce(cast(doc_id as varchar), '') as key, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as bytes
  from documents),
placed as (
  select doc_id, cast(len(bytes) + 8 as bigint) as size,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32,
    list_transform(range(25), lambda i: substr(md5('0:' || i || ':' || key), 1, 13)) as u, md5('0:slot:' || key) as spot
  from held, crc),
best as (select *, list_position(u[1:24], list_max(u[1:24])) - 1 as shard from placed)
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard,
  row_number() over (partition by shard order by spot, doc_id, text_crc32, size) - 1 as slot,
  cast(case when u[25] > list_max(u[1:24]) then 24 else shard end as int) as grown_shard
from best"""
