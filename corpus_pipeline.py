"""From raw documents to shards for training: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm.common import made, read, removed, written
from sparkvane.llm.stages import STAGES

#: Toxicity, near duplicates and alignment can't be said in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is a written table. Tables that only led to it are deleted."""
    docs, last = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        before = set(made())
        docs = written(stage(spark, docs, sf_dir))
        new = [t for t in made() if t not in before]
        removed(spark, last + new[:-1])
        last = new[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
