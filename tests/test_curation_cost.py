"""What rows cost: judged once whatever the number of users, and no regex over the whole of a text to strip it or to count a few words."""

import pytest
from pyspark.sql import functions as F

from sparkvane.functions.rules import CurationRules
from sparkvane.functions.text import has_words, py_rstrip, py_strip
from sparkvane.operators import curate
from sparkvane.sources import tables

TEXTS = ["", " ", "a", "  a b ", "a\x1cb\x1f", " a b　c\u0085", "a​b c", "x\r\n ", "\x0b\x0ca  b\t\nc d", "é " * 45]


@pytest.mark.parametrize("n", [-1, 0, 1, 2, 3, 40, 45, 46, 501])
def test_words_are_those_of_python(spark, n):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r[0]: r[1] for r in df.select("t", has_words(F.col("t"), n)).collect()}
    assert got == {t: len(t.split()) >= n for t in TEXTS}


def test_white_space_is_that_of_python(spark):
    texts = TEXTS + [chr(c) + "x" + chr(c) for c in [*range(1, 0x300), *range(0x1600, 0x1800), *range(0x2000, 0x2100), 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", py_strip(F.col("t")), py_rstrip(F.col("t")))
    assert [(r[1], r[2]) for r in df.collect()] == [(r["t"].strip(), r["t"].rstrip()) for r in df.collect()]


def test_rows_of_many_users_are_judged_once(spark):
    t = spark.createDataFrame([("1", "7", "", None, "u", "m", "A quiet tune (1994) of some words.")], "session_id string, user_id string, user_profile string, conversation_goal string, user_query string, music_id string, assistant_raw string")
    tracks = spark.createDataFrame([("m", ["n"], ["a"], ["b"], ["1990"], None)], tables.TRACKS)
    users = spark.range(100_002).select(F.col("id").cast("string").alias("user_id"), F.lit("x").alias("age_group"), F.lit(None).cast("string").alias("gender"), F.lit("y").alias("country_name"))
    rows = curate.sft_rows(curate.judged(t, tracks, CurationRules(min_words=3)), users, "p", "r")
    assert "user_id: 7" in rows.first()["system_prompt"]
    assert "apologi[sz]e" not in rows._jdf.queryExecution().optimizedPlan().toString()  # they were written before the join
