"""Removal of lines that an earlier document has, by levelled sorted runs of line hashes. SQL functions only.

Batches of documents come in the order of doc_id. The hashes of all lines kept so far are in runs: tables
bucketed and sorted by hash. A batch's distinct hashes, each with its first document in the batch, are merge-anti-joined
with every run, which are read without a shuffle; what is left is new, becomes a run of level 0
itself, and says which lines of the batch stay. FANOUT runs of a level are compacted into one of the next, so that
a batch meets a number of runs that grows as the logarithm of the batches.

A line that very many documents share is one row for each task before it is shuffled (its least document). Which lines go
is decided by an anti-join on hash and document together, which no line's copies make hot. Texts move
once, to meet the places of their dropped lines. Lines are told apart by two 64-bit hashes.

Defined cases. Documents are ordered by doc_id; rows of one doc_id are one document in this, and all of them keep the
lines that no lesser doc_id has. Rows without doc_id come last, ordered among themselves by a hash of their texts; those of equal
texts are one document. A null or empty text is one empty line. A document of which all lines go keeps the empty text.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import read, written

#: Key lengths in code points from which a line counts.
LEAST = 10
#: Batches that a whole table is cut into; documents that come later are batches of their own.
BATCHES = 5
FANOUT = 3
_ENDS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Runs:
    """Hashes (h1, h2) of lines seen, as runs by level, each a bucketed and sorted table of the session's catalog."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _stored(self, hashes: DataFrame, level: int) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        hashes.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The batch's hashes that no run has, with the least `own` that has them; not yet a run."""
        found = lines.groupBy("h1", "h2").agg(F.min("own").alias("own"))
        for name in self.tables():
            found = found.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return found

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (own, h1, h2 and more) that go: their hash is in a run, or a lesser `own` of the batch has it. The batch becomes a run."""
        kept = self._stored(self.fresh(lines), 0).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("own").alias("k_own"))
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("own") == F.col("k_own"))
        gone = written(lines.join(kept, same, "left_anti"))
        self.compact()
        return gone

    def compact(self) -> None:
        """Levels that have `fanout` runs become one run of the next level; the parts go when that is stored."""
        for level in range(len(self.levels)):
            if len(parts := self.levels[level]) >= self.fanout:
                both = self.spark.table(parts[0])
                for name in parts[1:]:
                    both = both.unionByName(self.spark.table(name))
                self._stored(both.repartition(self.buckets, "h1", "h2"), level + 1)
                self.levels[level] = []
                for name in parts:
                    self.spark.sql(f"drop table {name}")

    def drop(self) -> None:
        for name in self.tables():
            self.spark.sql(f"drop table {name}")
        self.levels = []


def key(line: Column) -> Column:
    """What makes lines the same: without space and the controls 9 to 13 at both ends, A to Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_ENDS)), _UPPER, _LOWER)


def hashed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, own (what orders documents), pos, h1, h2 of every line whose key has so many code points."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = parts.select("doc_id", "text_hash", F.coalesce("doc_id", "text_hash").alias("own"), "pos", key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least).select("doc_id", "text_hash", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def cuts(docs: DataFrame, batches: int) -> list[int]:
    """At most batches - 1 document ids that cut the table into batches of about as many rows. Where exactly doesn't matter to the result."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 1000)).head()[0] if shares else None
    return sorted(set(found or []))


def without_repeats(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays) of every row of docs."""
    spark = docs.sparkSession
    at = F.lit(0)
    for cut in (found := cuts(docs, batches)):
        at += F.when(F.col("doc_id") > cut, 1).otherwise(0)
    lines = written(hashed_lines(docs, least).withColumn("batch", F.when(F.col("doc_id").isNull(), len(found) + 1).otherwise(at)), "batch")
    runs, gone = Runs(spark, fanout), None
    for batch in range(len(found) + 2):
        dropped = runs.add(lines.where(F.col("batch") == batch)).select("doc_id", "text_hash", "pos")
        gone = dropped if gone is None else gone.unionByName(dropped)
    runs.drop()
    marks = gone.groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    rows = rows.select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines but those that a document of lesser doc_id has; null texts are one empty line, rows without doc_id come last, an empty table gives no rows."""
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = rf"""
with doc as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (
  select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from doc),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from line),
judged as (
  select *, length(key) >= {LEAST} and doc_id > min(doc_id) over (partition by key) as gone from keyed)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by r, doc_id
"""
