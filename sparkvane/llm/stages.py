"""Operators applied to a table of documents, as a pipeline's stages. Each keeps the columns it gets.

Defined cases, besides the operators' own. Toxicity and decontamination judge rows alone, so nulls, ties
and repeated rows need no rule; a null text is neither toxic nor contaminated. Of near duplicates the
document with the least doc_id stays, and of rows with one doc_id the one with the greatest text;
rows without doc_id all stay. Mixing repeats a row as often as the mix takes it. Other columns
are carried along whatever their names, as helper columns get names that no column has; those that
sharding adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from sparkvane.llm.common import SMALL, columns, fresh, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(F.col("text"), model) < 0.5)


def _counted(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids as a table to join with, broadcast if they are few, and their number."""
    n = ids.count()
    return F.broadcast(ids) if n <= SMALL else ids, n


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a Jaccard similarity of 0.8 or more on five-word shingles."""
    found = written(jaccard_join.classes(docs.where(F.col("doc_id").isNotNull()), jaccard_join.Rule(words=5, num=80, den=100)))
    gone_id, again_id, row_, id_ = (fresh(docs, n) for n in ("gone", "again", "row", "id"))
    gone, _ = _counted(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    kept = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    again, n = _counted(found.groupBy(F.col("doc_id").alias(again_id)).count().where("count > 1").select(again_id))
    if not n:
        return kept
    once = kept.join(again, F.col("doc_id") == F.col(again_id), "left_anti")
    several = kept.join(again, F.col("doc_id") == F.col(again_id), "left_semi")
    row = F.struct(*columns(docs))
    one = several.groupBy(F.col("doc_id").alias(id_)).agg(F.max_by(row, F.struct("text", F.xxhash64(*columns(docs)))).alias(row_))
    return once.unionByName(one.select(f"{row_}.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    names = {c: fresh(docs, f"taken_{c}") for c in ("doc_id", "source", "text_hash", "copies")}
    taken = mixing.mix(docs).where("copies > 0").select(*[F.col(c).alias(n) for c, n in names.items()])
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.xxhash64("text") == F.col(names["text_hash"]))
    nth = fresh(docs, "nth")
    out = docs.join(taken, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))))
    return out.select(*columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs, [1.0] * 24)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
