"""Connected components of a graph in a table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.llm.common import SMALL, written

#: Parts that the rows of a node that very many point to are dealt out to.
SALTS = 16


def _moved(rows: DataFrame, key: str, up: DataFrame, few: bool, out: str) -> DataFrame:
    """rows with `out`: where the node in column `key` goes by `up` (node, up), or the node itself.

    The centre of a large group is the key of a large share of the rows: `up` is broadcast if it is few, else its
    rows that are asked for are repeated for each salt.
    """
    to = up.select(F.col("node").alias("__n"), F.col("up").alias(out))
    if few:
        moved = rows.join(F.broadcast(to), F.col(key) == F.col("__n"), "left")
    else:
        to = to.join(rows.select(F.col(key).alias("__k")).distinct(), F.col("__n") == F.col("__k"), "left_semi")
        to = to.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__t", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        moved = salted.join(to, (F.col(key) == F.col("__n")) & (F.col("__t") == F.col("__s")), "left").drop("__s", "__t")
    return moved.withColumn(out, F.coalesce(out, key)).drop("__n")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges a, b; a node without edges has no row.

    Each round every node goes to its least neighbour, if that is less than itself, and on to where
    that one goes; what is between the nodes left is the next round's graph. Rounds are few: a
    round leaves at most half of the nodes that still have edges. Every round is a written table.
    """
    left = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")))
        few = up.count() <= SMALL
        for _ in range(2):
            up = _moved(up, "up", up, few, "further").select("node", F.col("further").alias("up"))
        up = written(up)
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            labels = _moved(labels, "component", up, few, "further").select("node", F.col("further").alias("component"))
        labels = written(labels)
        ends = _moved(_moved(left, "a", up, few, "ua"), "b", up, few, "ub")
        left = written(ends.where("ua <> ub").select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
