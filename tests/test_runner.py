"""The stages end to end on a small catalog, the trainer's configuration and the file tokenizer."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkvane.operators import tensorprep, training
from sparkvane.plans import runner
from sparkvane.sources import tables

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
RESPONSE = "This one fits a slow evening very well, and *Song 1* (1994) is where it begins. " + "It has strings and a patient rhythm. " * 6


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("music")
    tracks = [(f"t{i:02}", [f"Song {i}"], [f"Artist {i % 5}"], ["Album"], [f"{1980 + i}-01-01"], ["slow", "strings"] if i % 2 else None) for i in range(30)]
    turns = lambda i: [(1, "user", f"something like song {i}"), (1, "music", f"t{i:02}"), (1, "assistant", RESPONSE if i % 4 else "no")]
    spark.createDataFrame(tracks, tables.TRACKS).write.parquet(f"{root}/tracks.parquet")
    train = [(f"s{i:02}", f"u{i}", None, None, turns(i % 30)) for i in range(80)]
    spark.createDataFrame(train, tables.SESSIONS).write.parquet(f"{root}/train_sessions.parquet")
    test = [(f"x{i}", f"u{i}", None, "calm", [*turns(i), (2, "user", "one more, please")]) for i in range(4)]
    spark.createDataFrame(test, tables.SESSIONS).write.parquet(f"{root}/test_sessions.parquet")
    (root / "persona.txt").write_text(" A guide.\n", encoding="utf-8")
    settings = runner.Settings(str(root), f"{root}/work", f"{root}/out", "base", rules_text="Be kind.", persona_file=str(root / "persona.txt"), expected=4)
    run = runner.Run(spark, settings)
    return run, runner.run_stages(run)


def test_all_stages_run(spark, made):
    run, became = made
    assert became == dict.fromkeys(["dataset", "train", "inference", "package"], "done")
    funnel = spark.read.parquet(run.path("funnel")).first().asDict()
    assert funnel["total_sessions"] == 80 == sum(v for k, v in funnel.items() if k != "total_sessions") and funnel["kept"] == spark.read.parquet(run.path("rows")).count() == sum(i % 30 % 4 > 0 for i in range(80)) == 59
    rows = spark.read.parquet(run.path("rows"))
    assert rows.first()["system_prompt"].startswith("A guide.\n\nBe kind.\n\n")
    sample = spark.read.parquet(run.path("sample")).collect()
    assert len(sample) == 1 and sample[0]["assistant_response"] == RESPONSE[:300].strip() and sample[0]["music_id"] == "t01"
    split = spark.read.parquet(run.path("split"))
    config = training.read_config(spark, run.path("training"))
    assert split.where("split = 'eval'").count() == config["n_eval"] == 2 and config["n_train"] == 57 and config["eval_steps"] == 100
    with zipfile.ZipFile(f"{run.settings.output}/prediction.zip") as z:
        found = json.loads(z.read("prediction.json"))
    assert [x["session_id"] for x in found] == ["x0", "x1", "x2", "x3"] and {x["turn_number"] for x in found} == {2}
    assert all(len(set(x["predicted_track_ids"])) == 20 for x in found) and found[1]["predicted_track_ids"][0] == "t01"


def test_skips_subsets_and_needs(spark, made, tmp_path):
    run, _ = made
    only = runner.with_settings(run, skip=("dataset", "train"), subset=2, output=str(tmp_path / "o"))
    assert runner.run_stages(only) == {"dataset": "skipped: asked for", "train": "skipped: asked for", "inference": "done", "package": "skipped: a subset has too few rows"}
    assert len(json.load(open(tmp_path / "o" / "predictions.json"))) == 2
    with pytest.raises(FileNotFoundError, match="inference needs"):
        runner.run_stages(runner.with_settings(run, skip=("dataset", "train"), adapter=str(tmp_path / "none")))
    with pytest.raises(FileNotFoundError, match="train needs"):
        runner.run_stages(runner.with_settings(run, skip=("dataset",), work=str(tmp_path / "w")))
    with pytest.raises(ValueError, match="no stages"):
        runner.run_stages(runner.with_settings(run, skip=("dtaset",)))


def test_a_broken_list_is_not_packaged(made, tmp_path):
    (tmp_path / "predictions.json").write_text("[]")
    with pytest.raises(ValueError, match="V02"):
        runner.package(runner.with_settings(made[0], output=str(tmp_path)))


def test_no_rows_for_max_rows_zero(spark, made, tmp_path):
    none = runner.with_settings(made[0], max_rows=0, work=str(tmp_path), skip=("inference", "package"))
    runner.run_stages(none)
    assert spark.read.parquet(none.path("funnel")).first()["total_sessions"] == 0
    assert training.read_config(spark, none.path("training"))["eval_strategy"] == "no"


def test_settings_from_the_environment():
    env = {"SPARKVANE_ROOT": "r", "SPARKVANE_SUBSET": "3", "SPARKVANE_MAX_ROWS": "0", "SPARKVANE_SKIP": "train,package", "SPARKVANE_EVAL_FRACTION": "0.1"}
    s = runner.Settings.from_environment(env, work="w", output="o", base_model="b", subset=5)
    assert (s.root, s.subset, s.max_rows, s.skip, s.eval_fraction) == ("r", 5, 0, ("train", "package"), 0.1)


def test_training_configuration():
    assert len(training.TrainingConfig("b", targets="attn_mlp").exported(9, 0)["targets"]) == 7
    assert training.pad_id(None, 7) == 7 and training.pad_id(0, 7) == 0
    with pytest.raises(ValueError):
        training.TrainingConfig("b", targets="all")


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")
def test_file_tokenizer_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["a tune <|endoftext|> of Zürich", "", None, "日本 " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["ids"] for r in df.select("i", tensorprep.file_tokenizer(VOCABULARY)(F.col("t")).alias("ids")).collect()}
    back = Tokenizer.from_file(VOCABULARY)
    assert [back.decode(got[i], skip_special_tokens=False) for i in range(4)] == [t or "" for t in texts]
    rows = spark.createDataFrame([("a", "s", "u", "one two")], "session_id string, system_prompt string, user_query string, assistant_response string")
    r = tensorprep.masked(tensorprep.templated(rows), tensorprep.file_tokenizer(VOCABULARY), 100).first()
    k = sum(x == -100 for x in r["labels"])
    assert 0 < k < len(r["labels"]) and r["labels"][k:] == r["input_ids"][k:]


def test_a_run_goes_on_where_it_broke_off(spark, made, tmp_path, monkeypatch):
    """A stage that breaks off, a setting, a source and a table that changes: only what depends on it is done again."""
    root = tmp_path / "music"
    run = runner.with_settings(made[0], work=str(tmp_path / "work"), output=str(tmp_path / "out"), root=str(root))
    for name in ("tracks", "train_sessions", "test_sessions"):
        spark.read.parquet(f"{made[0].settings.root}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    done = lambda *again: {s: "done" if s in again else "done before" for s in runner.STAGES}

    def broken(run):
        raise OSError("lost half-way")

    with monkeypatch.context() as m:
        m.setitem(runner.STAGES, "inference", broken)
        with pytest.raises(OSError):
            runner.run_stages(run, resume=True)
    assert [runner.is_done(run, s) for s in runner.STAGES] == [True, True, False, False]
    assert runner.run_stages(run, resume=True) == done("inference", "package")
    assert runner.run_stages(run, resume=True) == done()
    longer = runner.with_settings(run, max_length=40)
    assert runner.run_stages(longer, resume=True) == done("train")
    fewer = runner.with_settings(longer, max_rows=60)
    assert runner.run_stages(fewer, resume=True) == done("dataset", "train")
    spark.createDataFrame([("u1", "20s", None, "Chile")], tables.USERS).write.parquet(f"{root}/users.parquet")
    assert runner.run_stages(fewer, resume=True) == done("dataset", "train", "inference", "package")
    os.remove(tmp_path / "out" / "prediction.zip")
    assert runner.run_stages(fewer, resume=True) == done("package")
    assert runner.run_stages(fewer) == dict.fromkeys(runner.STAGES, "done")
    assert spark.read.parquet(run.path("masked")).first().asDict() == {"before": 44, "after": 0, "dropped": 44}


@pytest.mark.parametrize("n", [0, 1, 49, 50, 777, 999, 1000, 2000])
def test_first_rows_of_many_are_found_by_counts(spark, monkeypatch, n):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("session_id"), F.col("id").alias("x")).repartition(7)
    want = sorted(map(tuple, df.orderBy("session_id").limit(n).collect()))
    monkeypatch.setattr(runner, "TOP", 20)
    assert sorted(map(tuple, runner.head(df, n).collect())) == want
    assert runner.head(df, None) is df
