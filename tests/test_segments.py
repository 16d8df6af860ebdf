import random

import pytest
from pyspark.sql import functions as F

from sparkvane.operators import bm25
from sparkvane.operators.segments import Conflict, GrowingIndex
from sparkvane.sources import store

WORDS = [f"w{i}" for i in range(25)]


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, k=rng.randrange(0, 30))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc long, text string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(i, " ".join(random.Random(i).choices([*WORDS, "nowhere"], k=6))) for i in range(12)], "q long, text string")


def hits(index, queries, k=5):
    return sorted(map(tuple, bm25.search(index, queries, "q", "text", k).collect()))


@pytest.mark.parametrize("cells,kind", [(1 << 22, "long"), (50, "long"), (50, "string")])
def test_batches_scored_in_tasks_equal_pairs_added_up(spark, queries, monkeypatch, cells, kind):
    """Ties, equal documents, empty ones, ids of either kind, and few documents at a time."""
    docs = texts(1, range(150)) | {i: "w1 w2" for i in range(150, 165)} | {200: "", 201: None, None: "w1"}
    index = bm25.build(frame(spark, docs).withColumn("doc", F.col("doc").cast(kind)), "doc", "text")
    monkeypatch.setattr(bm25, "CELLS", cells)
    got = hits(index, queries)
    pairs = bm25.top(bm25.scores(index, queries, "q", "text"), 5)
    assert got == sorted(map(tuple, pairs.collect())) and len(got) == 60
    monkeypatch.setattr(bm25, "BATCH_QUERIES", 5)
    assert got == hits(index, queries)  # in several batches


def test_no_documents_and_no_known_terms(spark, queries):
    none = bm25.build(frame(spark, {}), "doc", "text")
    assert hits(none, queries) == []
    one = bm25.build(frame(spark, {1: "other words"}), "doc", "text")
    assert hits(one, queries) == [] and one.stats.first()["avgdl"] == 2.0
    asked = spark.createDataFrame([(None, "other"), (3, None), (4, "words words")], "q long, text string")
    assert [r[:2] for r in hits(one, asked)] == [(4, 1)]


def same(grown, docs, spark, queries):
    plain = bm25.build(frame(spark, docs), "doc", "text")
    assert hits(grown, queries) == hits(plain, queries)
    assert sorted(map(tuple, grown.df.collect())) == sorted(map(tuple, plain.df.collect()))
    assert grown.stats.first() == plain.stats.first()


def test_changes_equal_a_rebuilt_index(spark, tmp_path, queries):
    index, docs = GrowingIndex(spark, str(tmp_path / "ix")), {}
    assert index.index() is None
    index.delete(frame(spark, {1: ""}).select("doc"))
    assert index.state().version == 0
    for seed, ids, gone in ((1, range(40), []), (2, range(30, 60), [3, 4, 999]), (3, [3, 70], [31, 70])):
        new = texts(seed, ids)
        index.add(frame(spark, new), "doc", "text", frame(spark, dict.fromkeys(gone, "")).select("doc"))
        # what a change deletes and has anew stays
        docs = {i: t for i, t in docs.items() if i not in gone} | new
        same(index.index(), docs, spark, queries)
    index.delete(frame(spark, dict.fromkeys([5, 6, 50], "")).select("doc"))
    docs = {i: t for i, t in docs.items() if i not in (5, 6, 50)}
    same(index.index(), docs, spark, queries)
    before = index.index()
    index.compact()
    assert len(index.state().segments) == 1 and index.state().version == 5
    same(index.index(), docs, spark, queries)
    same(before, docs, spark, queries)  # a query that began before
    assert len([n for n in index.vacuum() if n.startswith("segments")]) == 4 and index.vacuum() == []
    same(GrowingIndex(spark, str(tmp_path / "ix")).index(), docs, spark, queries)


def test_a_change_that_fails_half_way_leaves_the_index_as_it_was(spark, tmp_path, queries, monkeypatch):
    index, docs = GrowingIndex(spark, str(tmp_path / "ix")), texts(4, range(20))
    index.add(frame(spark, docs), "doc", "text")

    def lost(*_):
        raise OSError("the driver is lost between segment and manifest")

    with monkeypatch.context() as m:
        m.setattr(store, "publish", lost)
        with pytest.raises(OSError):
            index.add(frame(spark, texts(5, range(10))), "doc", "text")
    same(GrowingIndex(spark, str(tmp_path / "ix")).index(), docs, spark, queries)
    assert len(store.names(spark, f"{tmp_path}/ix/segments")) == 2 and len(index.vacuum()) == 1
    index.add(frame(spark, texts(5, range(10))), "doc", "text")
    same(index.index(), docs | texts(5, range(10)), spark, queries)


def test_of_two_changes_at_once_one_is_refused(spark, tmp_path):
    index = GrowingIndex(spark, str(tmp_path / "ix"))
    index.add(frame(spark, {1: "w1"}), "doc", "text")
    seen = index.state()
    index.add(frame(spark, {2: "w2"}), "doc", "text")
    with pytest.raises(Conflict):
        index._publish(seen, seen.segments)
    assert index.state().version == 2 and not [n for n in store.names(spark, f"{tmp_path}/ix/manifests") if n.endswith(".tmp")]


def test_other_parameters_are_refused(spark, tmp_path):
    GrowingIndex(spark, str(tmp_path / "ix")).add(frame(spark, {1: "w1"}), "doc", "text")
    with pytest.raises(ValueError):
        GrowingIndex(spark, str(tmp_path / "ix"), bm25.BM25Params(k1=2.0))
