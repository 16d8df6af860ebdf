"""Joins with keyed dimensions that stand keys of any share of the rows.

A dimension of few rows (counted) is broadcast, and so are those rows of a larger one that are asked for, if they are few: then no row
moves. Of what is larger still, only the rows of the keys that very many rows have are broadcast; those
keys are found by a frequent-items sketch, which is of fixed size and merged from all tasks. The rows of other keys are
shuffled with the rest of the dimension, and rows without key meet nobody and don't move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.sources import store

#: Rows of a dimension that are broadcast as a whole at most.
FEW = 100_000
#: Keys that are broadcast at most, and keys that a sketch tracks: a key of over about a 1000th of the rows is found.
HOT, TRACKED = 256, 8192
#: A key is hot from this share of a shuffle partition's fair part on.
SHARE = 0.25


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys of so many rows that they would make a task of a shuffle uneven; HOT at most come to the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {HOT}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] > SHARE * found["n"] / parts]


def join_dimension(rows: DataFrame, dimension: DataFrame, key: str, by: str, how: str = "left", few: int = FEW, costly: bool = False) -> DataFrame:
    """rows with the columns of the dimension's row whose `by` equals `key`; `by` is a key of the dimension, and no column is in both.

    how: left or inner. Null keys match nothing. costly: rows that are dear to make are written once where they are read more than once.
    """
    if how not in ("left", "inner"):
        raise ValueError("rows are joined left or inner")
    same = F.col(key) == F.col(by)
    if dimension.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(dimension), same, how)
    if costly:
        rows = store.stored(rows, store.scratch(rows.sparkSession))
    known = rows.where(F.col(key).isNotNull())
    if few:
        asked = store.stored(known.select(F.col(key).alias(by)).distinct(), store.scratch(rows.sparkSession))
        if asked.limit(few + 1).count() <= few:
            return rows.join(F.broadcast(dimension.join(F.broadcast(asked), by, "left_semi")), same, how)
    hot = hot_keys(known, key)
    if hot:
        is_hot = F.col(key).isin(hot)
        out = known.where(is_hot).join(F.broadcast(dimension.where(F.col(by).isin(hot))), same, how)
        out = out.unionByName(known.where(~is_hot).join(dimension.where(~F.col(by).isin(hot)).hint("merge"), same, how))
    else:
        out = known.join(dimension.hint("merge"), same, how)
    if how == "inner":
        return out
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in dimension.schema]
    return out.unionByName(rows.where(F.col(key).isNull()).select("*", *none))
