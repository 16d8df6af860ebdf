import pytest
from pyspark.sql import functions as F

from sparkvane.functions.rules import REASONS, CurationRules
from sparkvane.operators import curate
from sparkvane.sources import store, tables
from sparkvane.sources.observed import write_observed
from sparkvane.streaming import curation

SCHEMA = "session_id string, user_query string, music_id string, assistant_raw string"
GOOD = "(1994) " + "w " * 40 + "end."


def triples(spark, ids):
    text = {0: GOOD, 1: "too short.", 2: "", 3: "Great! " + GOOD}
    return spark.createDataFrame([(str(i), f"play {i}", f"t{i % 6}", text[i % 4]) for i in ids], SCHEMA)


@pytest.fixture
def tracks(spark):
    return spark.createDataFrame([(f"t{i}", ["n"], ["a"], ["b"], ["1990"], None) for i in range(5)], tables.TRACKS)


def test_counters_of_a_write_equal_a_pass_of_their_own(spark, tracks, tmp_path):
    """Also where only some rows are kept, or there are none."""
    judged = curate.judged(triples(spark, range(200)).repartition(4), tracks, CurationRules())
    counted = write_observed(judged, f"{tmp_path}/rows", F.col("reason") == "kept", **curate.funnel_counters())
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert curate.funnel_stats(judged).first().asDict() == counted and list(counted) == ["total_sessions", *REASONS, "kept"]
    assert rows.count() == counted["kept"] > 0
    none = write_observed(judged.limit(0), f"{tmp_path}/none", **curate.funnel_counters())
    assert set(none.values()) == {0}


def test_the_plan_has_one_scan(spark, tracks, tmp_path):
    triples(spark, range(20)).write.parquet(f"{tmp_path}/in")
    judged = curate.judged(spark.read.parquet(f"{tmp_path}/in"), tracks, CurationRules())
    plan = judged.observe("c", *[c.alias(k) for k, c in curate.funnel_counters().items()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("CollectMetrics") == 1


def start(spark, tracks, tmp_path, files=1):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    return curation.curate_stream(source, tracks, CurationRules(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")


def test_a_stream_in_batches_with_restarts_equals_one_pass(spark, tracks, tmp_path, monkeypatch):
    ids = [range(0, 40), range(40, 90), range(90, 120)]
    triples(spark, ids[0]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start(spark, tracks, tmp_path).awaitTermination()
    triples(spark, ids[1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    with monkeypatch.context() as m:  # the second batch writes its rows, then breaks off
        m.setattr(curation, "COUNTERS", None)
        with pytest.raises(Exception, match="TypeError|NoneType"):
            start(spark, tracks, tmp_path).awaitTermination()
    assert curation.funnel(spark, f"{tmp_path}/out").first()["total_sessions"] == 40
    triples(spark, ids[2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start(spark, tracks, tmp_path).awaitTermination()
    whole = curate.judged(triples(spark, range(120)), tracks, CurationRules())
    assert curation.funnel(spark, f"{tmp_path}/out").first() == curate.funnel_stats(whole).first()
    key = lambda df: sorted((r.session_id, r.reason, r.cleaned) for r in df.collect())
    assert key(curation.judged(spark, f"{tmp_path}/out")) == key(whole)
    assert len(store.names(spark, f"{tmp_path}/out/funnel")) == 3


def test_a_stream_of_nothing(spark, tracks, tmp_path):
    triples(spark, []).write.parquet(f"{tmp_path}/in")
    start(spark, tracks, tmp_path).awaitTermination()
    assert set(curation.funnel(spark, f"{tmp_path}/out").first().asDict().values()) == {0}
