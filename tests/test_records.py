import json

import pytest
from pyspark.sql import functions as F

from sparkvane.functions.text import rendered_json
from sparkvane.operators.records import Shelf


def test_tables_of_a_shelf_meet_without_exchange(spark):
    shelf = Shelf(spark, "session_id")
    ids = F.col("id").cast("string").alias("session_id")
    a, b, c = (shelf.put(spark.range(n).select(ids, (F.col("id") * n).alias(f"x{n}"))) for n in (300, 200, 250))
    joined = shelf.joined(a, b, c)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert sorted((int(r.session_id), r.x300, r.x200, r.x250) for r in joined.collect()) == [(i, i * 300, i * 200, i * 250) for i in range(200)]
    names = list(shelf.names)
    shelf.drop()
    assert not {t.name for t in spark.catalog.listTables()} & set(names)


def test_null_and_repeated_keys(spark):
    shelf = Shelf(spark, "k", 3)
    rows = shelf.put(spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "k string, x int"))
    assert sorted((r.k, r.x, r.y) for r in shelf.joined(rows, shelf.put(spark.createDataFrame([("a", 9), (None, 8)], "k string, y int"))).collect()) == [("a", 2, 9), ("a", 3, 9)]
    assert shelf.joined(rows, shelf.put(spark.createDataFrame([], "k string, y int"))).collect() == []
    shelf.drop()


@pytest.mark.parametrize("value", ["text", "", "it's", {"a": [1, None, True, 1e-7, 2**70, {"b": "é\n"}]}, [], {}, 0, 1.5, False, "null"])
def test_goals_of_any_type(spark, value):
    raw = spark.createDataFrame([(json.dumps(value),)], "raw string")
    assert raw.select(rendered_json(F.col("raw"))).first()[0] == str(value)


def test_goals_that_are_none(spark):
    raw = spark.createDataFrame([("null",), (None,), ("{bad",), ("",)], "raw string")
    assert [r[0] for r in raw.select(rendered_json(F.col("raw"))).collect()] == [None] * 4
