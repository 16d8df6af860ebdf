"""The library's operators: rules on hand-made rows, and every query against DuckDB on the smallest tables."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvane.functions.rules import CurationRules, reason, strip_warm_opener
from sparkvane.functions.text import py_strip, py_words, rendered, track_line
from sparkvane.operators import bm25, curate, prompts, responder, tensorprep, training, validate
from sparkvane.plans import registry
from sparkvane.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_against_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want, cols = duck.sql(sql).df(), sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert text(got) == text(want)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,words", [("", 0), ("  ", 0), (" a  b c ", 3), ("x", 1)])
def test_python_words(spark, text, words):
    assert one(spark, py_words(F.lit(text))) == words == len(text.split())
    assert one(spark, py_strip(F.lit(text + "\x1f"))) == text.strip()


def test_warm_sentences_go_four_times(spark):
    strip = lambda t: one(spark, strip_warm_opener(F.lit(t), CurationRules()))
    assert strip("Great! " * 5 + "A tune.") == "Great! A tune."
    assert strip("Great.") == "" and strip(" no end ") == "no end" and strip("I was glad. Now. Sure!") == "Now. Sure!"


@pytest.mark.parametrize("user,music,text,known,expected", [
    (None, "m", "t", True, "missing_turn1_msg"), ("u", "", "t", True, "missing_turn1_music"), ("u", "m", None, True, "missing_turn1_asst"),
    ("u", "m", "t", False, "music_not_in_catalog"), ("u", "m", " NONE ", True, "junk_response"), ("u", "m", "w " * 39, True, "too_short"),
    ("u", "m", "Truly " + "w " * 40, True, "contains_banned"), ("u", "m", "I’m so sorry " + "w " * 40, True, "contains_apology"),
    ("u", "m", "glad you liked " + "w " * 40, True, "contains_hallucination"), ("u", "m", "untruly (94) " + "w " * 40, True, "no_citation"),
    ("u", "m", "(1994) " + "w " * 40 + ",", True, "bad_close"), ("u", "m", "“ab” " + "w " * 40 + "end)", True, "kept"),
])
def test_first_reason_counts(spark, user, music, text, known, expected):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, reason(lit(user), lit(music), lit(text), F.lit(known), py_strip(lit(text)), CurationRules())) == expected


def test_track_lines_leave_out_what_is_missing(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, track_line(a("N"), a("A"), a(), a("1994-05-01"), a(*"abcdefg"))) == '"N" by A (1994) [tags: a, b, c, d, e]'
    assert one(spark, track_line(a(), a(), a(), a(), F.lit(None).cast("array<string>"))) == '""'


def test_strict_transcripts_fail_on_unknown_tracks(spark):
    s = spark.createDataFrame([("s", [(1, "user", "hi"), (1, "music", "t9")])], "session_id string, conversations array<struct<turn_number:int,role:string,content:string>>")
    t = spark.createDataFrame([("t1", ["n"], ["a"], ["b"], ["d"], None)], tables.TRACKS)
    assert prompts.transcripts(s, t, strict=False).first()["transcript"] == "user: hi\nassistant: t9"
    with pytest.raises(Exception, match="unknown track t9"):
        prompts.transcripts(s, t).collect()


def test_masks_and_padding(spark):
    rows = spark.createDataFrame([("a", "s", "u", "one two"), ("b", "s", "u", "x")], "session_id string, system_prompt string, user_query string, assistant_response string")
    made = tensorprep.masked(tensorprep.templated(rows), tensorprep.word_tokenizer(), 100)
    for r in made.collect():
        k = sum(x == -100 for x in r["labels"])
        assert len(r["labels"]) == len(r["input_ids"]) == len(r["attention_mask"]) and r["labels"][k:] == r["input_ids"][k:]
    assert tensorprep.learnable(tensorprep.masked(tensorprep.templated(rows), tensorprep.word_tokenizer(), 2)).count() == 0
    assert len({len(r["input_ids"]) for r in tensorprep.padded(made, F.lit(0), 7).collect()}) == 1


@pytest.mark.parametrize("n,expected", [(49, 0), (50, 1), (101, 3)])
def test_eval_split_is_exact(spark, n, expected):
    assert tensorprep.eval_split(spark.range(n), "id", 0.02, 42).where("split = 'eval'").count() == expected


def test_index_is_kept_and_told_from_stale_ones(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple tree")], "doc long, text string")
    q = spark.createDataFrame([(1, "apple tree")], "q long, text string")
    index = bm25.build(docs, "doc", "text")
    bm25.save(index, str(tmp_path / "ix"), "v1")
    assert bm25.load(spark, str(tmp_path / "ix"), "v2") is None is bm25.load(spark, str(tmp_path / "none"), "v1")
    again = bm25.search(bm25.load(spark, str(tmp_path / "ix"), "v1"), q, "q", "text")
    assert [r.asDict() for r in again.collect()] == [r.asDict() for r in bm25.search(index, q, "q", "text").collect()]


def test_files_and_validation(spark, tmp_path):
    good = {"session_id": "é", "user_id": "u", "turn_number": 1, "predicted_track_ids": [str(i) for i in range(20)], "predicted_response": "Hi"}
    df = spark.createDataFrame([(good["session_id"], "u", 1, good["predicted_track_ids"], "Hi")], tables.PREDICTIONS)
    path = str(tmp_path / "p.json")
    tables.write_json_array(df, path, ["session_id"])
    assert json.load(open(path, encoding="utf-8")) == [good] and "é" in open(path, encoding="utf-8").read()
    assert tables.read_json_array(spark, path).collect() == df.collect()
    assert tables.write_zip(path, str(tmp_path / "p.zip")) == ["prediction.json"]
    raw = tables.read_raw_array(spark, path)
    assert validate.violations(raw, expected=1).count() == 0 and validate.first_violation(validate.violations(raw)).first()["rule"] == "V02"
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        tables.read_raw_array(spark, str(tmp_path / "bad.json"))


def test_optional_tables_and_responses(spark, tmp_path):
    r = tables.Registry({"users": tables.TableSpec("users.parquet", tables.USERS)}, str(tmp_path))
    assert r.optional(spark, "users").count() == 0
    p = spark.createDataFrame([("a", "x\n1. \"N\" by A"), ("b", "none")], "session_id string, system_prompt string")
    assert {x["session_id"]: x["predicted_response"] for x in responder.respond(p).collect()} == {"a": 'Try "N" by A.', "b": responder.EMPTY_RESPONSE}


def test_generations_are_stripped_like_python(spark):
    p = spark.createDataFrame([("a", "\n \t"), ("b", " \x1f x \n"), ("c", None)], "session_id string, said string")
    got = {r["session_id"]: r["predicted_response"] for r in responder.respond(p, lambda x: x["said"]).collect()}
    assert got == {"a": responder.EMPTY_RESPONSE, "b": "x", "c": responder.EMPTY_RESPONSE}


@pytest.mark.parametrize("turn,rules", [("1", []), ("true", []), ("null", ["V04"]), ('"1"', ["V04"]), ("1.5", ["V04"])])
def test_turn_numbers_are_whole(spark, turn, rules):
    ids = json.dumps([str(i) for i in range(20)])
    raw = f'{{"session_id": "s", "user_id": "u", "turn_number": {turn}, "predicted_track_ids": {ids}, "predicted_response": "x"}}'
    df = spark.createDataFrame([(0, raw)], "ordinal long, raw string")
    assert [r["rule"] for r in validate.violations(df, expected=1).collect()] == rules


def test_values_are_written_like_python(spark):
    values = [{"a": "it's", "b": 'say "x"', "c": "both ' and \"", "d": "new\nline\\ \x01é", "e": None}, {"a": "", "b": "é", "c": "\t", "d": "\r", "e": 7}]
    df = spark.createDataFrame([tuple(v.values()) for v in values], "a string, b string, c string, d string, e int").select(F.struct("*").alias("v"))
    assert [r[0] for r in df.select(rendered(F.col("v"), df.schema["v"].dataType)).collect()] == [str(v) for v in values]
    df = spark.createDataFrame([({"k": [True, None]},), (None,)], "v map<string,array<boolean>>")
    assert [r[0] for r in df.select(rendered(F.col("v"), df.schema["v"].dataType)).collect()] == ["{'k': [True, None]}", None]


def test_sources_are_read_into_the_schema(spark, tmp_path):
    spark.createDataFrame([("t1", "N", "A", None, "1994-01-01", 3)], "track_id string, track_name string, artist_name string, album_name string, release_date string, ordinal int").write.parquet(f"{tmp_path}/t.parquet")
    r = tables.Registry({"t": tables.TableSpec("t.parquet", tables.TRACKS)}, str(tmp_path)).scan(spark, "t").first()
    assert (r["track_name"], r["album_name"], r["tag_list"], r["ordinal"]) == (["N"], None, None, 3)
    spark.createDataFrame([("s", {"g": "x"})], "session_id string, conversation_goal map<string,string>").write.parquet(f"{tmp_path}/s.parquet")
    r = tables.Registry({"s": tables.TableSpec("s.parquet", tables.SESSIONS)}, str(tmp_path)).scan(spark, "s").first()
    assert r["conversation_goal"] == "{'g': 'x'}" and r["conversations"] is None


def test_eval_split_digit_by_digit(spark, monkeypatch):
    whole = {r["id"]: r["split"] for r in tensorprep.eval_split(spark.range(3000), "id", 0.1, 7).collect()}
    monkeypatch.setattr(tensorprep, "FEW", 1)
    assert whole == {r["id"]: r["split"] for r in tensorprep.eval_split(spark.range(3000), "id", 0.1, 7).collect()} and sum(s == "eval" for s in whole.values()) == 300


def test_batches_are_full(spark):
    sizes = sorted(r["count"] for r in tensorprep.batched(spark.range(1001), "id", 8, 1).groupBy("batch").count().collect())
    assert sizes == [1] + [8] * 125


def test_large_batches_of_queries_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)] + [(60, "")], "doc long, text string")
    q = spark.createDataFrame([(i, f"w{i} common common") for i in range(5)], "q long, text string")
    index = bm25.build(docs, "doc", "text")
    few = sorted(map(tuple, bm25.search(index, q, "q", "text").collect()))
    monkeypatch.setattr(bm25, "BATCH_TERMS", 2)
    assert few == sorted(map(tuple, bm25.search(index, q, "q", "text").collect())) and len(few) == 100
    assert index.stats.first()["n_docs"] == 61


def test_archives_and_devices(tmp_path):
    (tmp_path / "adapter" / "sub").mkdir(parents=True)
    (tmp_path / "adapter" / "a.bin").write_text("a")
    (tmp_path / "adapter" / "sub" / "b.json").write_text("{}")
    assert tables.write_archive(str(tmp_path / "adapter"), str(tmp_path / "a.zip")) == ["adapter/a.bin", "adapter/sub/b.json"]
    assert [training.device(*x)[0] for x in ((True, True), (False, True), (False, False))] == ["cuda", "mps", "cpu"]
    assert training.TrainingConfig("b", dtype="bfloat16").exported(1, 0)["bf16"]


def test_rows_are_judged_once(spark):
    """A filter on the reason must not pull the patterns below the generator."""
    t = spark.createDataFrame([("1", "u", "m", "text")], "session_id string, user_query string, music_id string, assistant_raw string")
    df = curate.judged(t, spark.createDataFrame([], tables.TRACKS), CurationRules()).where("reason = 'kept'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("apologi[sz]e") == 1 and plan.count("nailed") <= 4
