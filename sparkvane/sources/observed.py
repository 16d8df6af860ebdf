"""Counters of a write, taken while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


def write_observed(df: DataFrame, path: str, keep: Column | None = None, **counters: Column) -> dict[str, int]:
    """df, or its rows to keep, as a table at path, and aggregates over all its rows. Nothing is read or computed a second time.

    They are taken in the tasks that write, of which each partition's first success counts, however often it is tried.
    """
    seen = Observation()
    rows = df.observe(seen, *[c.alias(name) for name, c in counters.items()])
    (rows if keep is None else rows.where(keep)).write.mode("overwrite").parquet(path)
    return seen.get
