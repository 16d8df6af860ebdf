import statistics

import pytest
from pyspark.sql import functions as F

from sparkvane.operators.dimension import hot_keys, join_dimension


def plays(spark, n=20_000):
    """Two fifths of the rows have one key, a twentieth another, some none or an unknown one."""
    i = F.col("id")
    key = F.when(i % 5 < 2, "hot").when(i % 20 == 3, "warm").when(i % 50 == 4, F.lit(None)).when(i % 50 == 14, "unknown").otherwise(F.concat(F.lit("k"), (i * 7919 % 3000).cast("string")))
    return spark.range(n).select(i.alias("play"), key.alias("music_id"))


def catalog(spark):
    return spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("track_id"), F.col("id").alias("year")).union(spark.createDataFrame([("hot", -1), ("warm", -2)], "track_id string, year long"))


def test_hot_keys_are_found(spark):
    assert set(hot_keys(plays(spark), "music_id")) == {"hot", "warm"}
    assert hot_keys(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k") == []
    assert hot_keys(spark.createDataFrame([], "k string"), "k") == [] == hot_keys(spark.createDataFrame([(None,)], "k string"), "k")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("few", [0, 100_000])
def test_same_rows_as_a_plain_join(spark, how, few):
    rows, tracks = plays(spark, 3000), catalog(spark)
    got = join_dimension(rows, tracks, "music_id", "track_id", how, few)
    want = rows.join(tracks, rows.music_id == tracks.track_id, how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_other_kinds_of_join_are_refused(spark):
    with pytest.raises(ValueError):
        join_dimension(plays(spark), catalog(spark), "music_id", "track_id", "full")


def test_no_task_gets_the_hot_key(spark):
    """The rows of every task that meets shuffled rows, against a plain shuffle."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = plays(spark, 100_000)
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        plain = sizes(rows.join(catalog(spark).hint("merge"), F.col("music_id") == F.col("track_id"), "left"))
        assert max(plain) > 3 * statistics.median(plain)
        got = join_dimension(rows, catalog(spark), "music_id", "track_id", few=0)
        assert max(sizes(got)) <= 2 * statistics.median(sizes(got))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("SortMergeJoin") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_asked_rows_of_a_large_dimension_are_broadcast(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}" if i % 7 else None) for i in range(40)], "play long, music_id string")
    for costly in (False, True):
        got = join_dimension(rows, catalog(spark), "music_id", "track_id", few=5, costly=costly)
        want = rows.join(catalog(spark), rows.music_id == F.col("track_id"), "left")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
