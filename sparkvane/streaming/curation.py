"""Curation of sessions as they arrive.

Each micro-batch is judged against the static catalog and written to a folder of its number, which a batch that is run again
after a failure overwrites, so that every session counts once. The counters of a batch are taken by the job that writes
it. What is known of a stream is what its checkpoint and those folders say: a stream that is started anew goes on after the last whole batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkvane.functions.rules import REASONS, CurationRules
from sparkvane.operators import curate
from sparkvane.sources import store
from sparkvane.sources.observed import write_observed

COUNTERS = ["total_sessions", *REASONS, "kept"]


def _into(out: str, judge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def batch(rows: DataFrame, number: int) -> None:
        counted = write_observed(judge(rows), f"{out}/rows/batch={number}", **curate.funnel_counters())
        one = rows.sparkSession.createDataFrame([tuple(counted[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
        one.write.mode("overwrite").parquet(f"{out}/funnel/batch={number}")

    return batch


def curate_stream(triples: DataFrame, tracks: DataFrame, rules: CurationRules, out: str, checkpoint: str) -> StreamingQuery:
    """Starts to judge a stream of triples (session_id, user_query, music_id, assistant_raw and more) until all that is there is done."""
    judge = lambda rows: curate.judged(rows, tracks, rules)
    return triples.writeStream.foreachBatch(_into(out, judge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged(spark: SparkSession, out: str) -> DataFrame:
    """All judged rows so far, with their batch."""
    return spark.read.parquet(f"{out}/rows")


def funnel(spark: SparkSession, out: str) -> DataFrame:
    """One row: the counters of all batches so far."""
    if not store.exists(spark, f"{out}/funnel"):
        return spark.createDataFrame([(0,) * len(COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
    return spark.read.parquet(f"{out}/funnel").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
