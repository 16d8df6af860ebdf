"""Every query of the library, and its DuckDB SQL where there is one."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.rules import APOLOGY, BANNED, CLOSERS, HALLUCINATION, REASONS, WARM_ANYWHERE, WARM_START, CurationRules, strip_warm_opener
from sparkvane.functions.text import CANDIDATES_HEAD, corpus_text, metadata_text, profile_text, rendered, rendered_json, track_line
from sparkvane.operators import bm25, curate, dimension, prompts, records, responder, segments, tensorprep, validate
from sparkvane.plans import fixtures as fx
from sparkvane.plans import runner
from sparkvane.sources import observed, store, tables
from sparkvane.streaming import curation

RULES = CurationRules.fixture()
FIELDS = prompts.FIELDS
_text = lambda a: F.array_join(a, ",")  # noqa: E731  arrays are compared as text
TOP, DEEP, FIRST = 20, 40, 3


def _index(spark, sf_dir):
    """The index of the documents, stored, as the queries read it several times."""
    path = store.scratch(spark)
    bm25.save(bm25.build(fx.short_corpus(spark, sf_dir), "doc_id", "text"), path, "documents")
    return bm25.load(spark, path, "documents")


def _grown(spark, sf_dir):
    """A stored index of documents that came in three changes, the second of which replaces some and the third deletes some."""
    docs, d = fx.short_corpus(spark, sf_dir), F.col("doc_id")
    index = segments.GrowingIndex(spark, store.scratch(spark))
    index.add(docs.where(d % 10 < 7), "doc_id", "text")
    again = docs.where(d % 50 == 0).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" the text was changed "), F.coalesce("text", F.lit(""))))
    index.add(docs.where((d % 10 >= 7) & (d % 10 < 9)).unionByName(again), "doc_id", "text")
    index.add(docs.where(d % 10 == 9), "doc_id", "text", docs.where(d % 20 == 3).select(d.alias("doc")))
    return index


def bm25_growing_top20(spark, sf_dir):
    """Over three segments, with documents replaced and deleted."""
    return _ranked(bm25.search(_grown(spark, sf_dir).index(), fx.read(spark, sf_dir, "benchmark"), "item_id", "text", TOP))


def bm25_growing_stats(spark, sf_dir):
    """Merged statistics, before and after compaction, and the segments that it leaves."""
    index, out = _grown(spark, sf_dir), None
    for name in ("segments", "compacted"):
        ix = index.index()
        df = ix.df.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
        row = ix.stats.crossJoin(F.broadcast(df)).select(F.lit(name).alias("state"), "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")
        out = row if out is None else out.unionByName(row)
        index.compact()
    return out


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("doc").alias("doc_id"), F.round(F.col("score").cast("double"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_top20(spark, sf_dir):
    return _ranked(bm25.search(_index(spark, sf_dir), fx.read(spark, sf_dir, "benchmark"), "item_id", "text", TOP))


def bm25_stats(spark, sf_dir):
    ix = _index(spark, sf_dir)
    df = ix.df.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return ix.stats.crossJoin(F.broadcast(df)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


def bm25_zero_fill(spark, sf_dir):
    """Of queries that match little: two items, and one of a word that is nowhere."""
    q = fx.read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.lit("qqqqzzzz")).otherwise(F.regexp_extract("text", r"\S+\s*$", 0)).alias("text"))
    return _ranked(bm25.search(_index(spark, sf_dir), q, "item_id", "text", TOP, zero_fill=True))


def bm25_transcript_top20(spark, sf_dir):
    q = prompts.transcripts(fx.sessions(spark, sf_dir), fx.tracks(spark, sf_dir), strict=False)
    found = bm25.search(_index(spark, sf_dir), q, "session_id", "transcript", TOP)
    return _ranked(found)


def ordered_dedupe_top3(spark, sf_dir):
    found = bm25.search(_index(spark, sf_dir), fx.read(spark, sf_dir, "benchmark"), "item_id", "text", DEEP)
    lists = bm25.hit_lists(found, TOP)
    return lists.select("qid", _text(F.transform("hits", lambda x: x.cast("string"))).alias("hits"), _text(F.transform(F.slice("hits", 1, FIRST), lambda x: x.cast("string"))).alias("top3"))


def bm25_catalog_top20(spark, sf_dir):
    """Transcripts against the track catalog, both whole: what the engine does for a test set. Sessions of unknown tracks can't be asked."""
    tracks = fx.tracks(spark, sf_dir)
    index = bm25.build(tracks.select("track_id", corpus_text({f: F.col(f) for f in FIELDS}).alias("text")), "track_id", "text")
    found = bm25.search(index, strict_transcript(spark, sf_dir), "session_id", "transcript", TOP)
    return _ranked(found).withColumnRenamed("doc_id", "track_id")


def turn1_pivot(spark, sf_dir):
    return curate.first_turn(fx.sessions(spark, sf_dir)).select(F.concat("session_id", F.lit("_t1")).alias("session_id"), "user_query", "music_id", "assistant_raw")


def last_turn(spark, sf_dir):
    return curate.last_turn(fx.sessions(spark, sf_dir))


def transcript(spark, sf_dir):
    return prompts.transcripts(fx.sessions(spark, sf_dir), fx.tracks(spark, sf_dir), strict=False)


def strict_transcript(spark, sf_dir):
    """Transcripts with the error for unknown tracks in place, of the sessions whose track is known."""
    sessions, tracks = fx.sessions(spark, sf_dir), fx.tracks(spark, sf_dir)
    known = curate.first_turn(sessions).join(tracks, F.col("music_id") == F.col("track_id"), "left_semi")
    return prompts.transcripts(known.select("session_id", "conversations"), tracks)


def warm_strip(spark, sf_dir):
    return tables.spread(fx.short_corpus(spark, sf_dir)).select("doc_id", strip_warm_opener(F.col("text"), RULES).alias("stripped"))


def _judged(spark, sf_dir):
    return curate.judged(fx.triples(spark, sf_dir), fx.tracks(spark, sf_dir), RULES)


def funnel_stats(spark, sf_dir):
    return curate.funnel_stats(_judged(spark, sf_dir))


def observed_funnel(spark, sf_dir):
    """The counters as the job that writes the judged rows sees them."""
    counted = observed.write_observed(_judged(spark, sf_dir), f"{store.scratch(spark)}/judged", **curate.funnel_counters())
    names = curation.COUNTERS
    return spark.createDataFrame([tuple(counted[c] for c in names)], ", ".join(f"{c} long" for c in names))


def _streamed(spark, sf_dir):
    """The output folder of a stream over all triples in three parts, stopped after the first and started again."""
    path, parts = store.scratch(spark), 3
    triples = fx.triples(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(parts)))
    tracks = fx.tracks(spark, sf_dir)
    for part in range(parts):
        triples.where(F.col("part") == part).drop("part").coalesce(8).write.mode("append").parquet(f"{path}/arrived")
        source = spark.readStream.schema(triples.drop("part").schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/arrived")
        curation.curate_stream(source, tracks, RULES, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


def streamed_funnel(spark, sf_dir):
    return curation.funnel(spark, _streamed(spark, sf_dir))


def streamed_reason_rows(spark, sf_dir):
    return curation.judged(spark, _streamed(spark, sf_dir)).select("session_id", "reason")


def funnel_reason_rows(spark, sf_dir):
    return _judged(spark, sf_dir).select("session_id", "reason")


def funnel_default_lexicon(spark, sf_dir):
    """The funnel by the default patterns."""
    return curate.judged(fx.phrased(spark, sf_dir), fx.tracks(spark, sf_dir), CurationRules()).select("session_id", "reason", F.md5("cleaned").alias("cleaned_md5"))


def sft_rows(spark, sf_dir):
    return curate.sft_rows(_judged(spark, sf_dir), fx.users(spark, sf_dir), fx.PERSONA, fx.RULES_TEXT)


def track_lines(spark, sf_dir):
    return fx.tracks(spark, sf_dir).select("track_id", track_line(*[F.col(f) for f in FIELDS], F.col("tag_list")).alias("line"))


def scalar_track_lines(spark, sf_dir):
    return fx.scalar_tracks(spark, sf_dir).select("track_id", track_line(*[F.col(f) for f in FIELDS], F.col("tag_list")).alias("line"))


def dict_goals(spark, sf_dir):
    held = fx.goals(spark, sf_dir)
    return held.select("track_id", rendered(F.col("goal"), held.schema["goal"].dataType).alias("goal"))


def mixed_goals(spark, sf_dir):
    """Goals of every type that JSON has, some nested, as Python writes them."""
    p, n, name = fx.read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    size, price = F.col("p_size").cast("string"), F.round(n / 8, 3).cast("string")
    nested = F.concat(F.lit('{"mood": {"name": "'), name, F.lit('", "of": ['), size, F.lit(', null, true, "it\'s"]}, "\\u00e9": '), price, F.lit("}"))
    kinds = {0: F.concat(F.lit('"'), name, F.lit('"')), 1: nested, 2: F.concat(F.lit("[["), size, F.lit('], {}, ""]')), 3: size, 4: F.lit("null"), 5: F.lit("false"), 6: F.lit("{no JSON")}
    goal = F.coalesce(*[F.when(n % 7 == k, v) for k, v in kinds.items()])
    return p.select(n.cast("string").alias("track_id"), rendered_json(goal).alias("goal"))


def prediction_records(spark, sf_dir):
    """Last turns, transcripts and responses of all sessions, stored side by side and joined without exchange. Sessions are put together once."""
    shelf, sessions = records.Shelf(spark, "session_id"), store.stored(fx.sessions(spark, sf_dir), store.scratch(spark))
    last = shelf.put(curate.last_turn(sessions).select("session_id", "turn_number"))
    said = shelf.put(prompts.transcripts(sessions, fx.tracks(spark, sf_dir), strict=False))
    return shelf.joined(last, said, shelf.put(responder.respond(_prompts(spark, sf_dir, sessions))))


def sample_preview(spark, sf_dir):
    return runner.sample(sft_rows(spark, sf_dir))


def metadata(spark, sf_dir):
    return fx.tracks(spark, sf_dir).select("track_id", metadata_text(F.col("track_id"), {f: F.col(f) for f in FIELDS}).alias("metadata"))


def corpus(spark, sf_dir):
    return fx.tracks(spark, sf_dir).select("track_id", corpus_text({f: F.col(f) for f in FIELDS}).alias("corpus"))


def profiles(spark, sf_dir):
    return fx.users(spark, sf_dir).select("user_id", profile_text(F.col("user_id"), F.col("age_group"), F.col("gender"), F.col("country_name")).alias("profile"))


def train_prompt(spark, sf_dir):
    return sft_rows(spark, sf_dir).select("session_id", F.md5("system_prompt").alias("prompt_md5"), F.length("system_prompt").alias("prompt_length"))


def _picks(sessions):
    """Three tracks of each session, some unknown."""
    s = sessions.select("session_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"))
    return s.select("session_id", "rank", ((F.col("session_id").cast("long") * 37 + F.col("rank") * 600) % 2500).cast("string").alias("track_id"))


def _prompts(spark, sf_dir, sessions):
    return prompts.inference_prompts(sessions, fx.users(spark, sf_dir), _picks(sessions), fx.tracks(spark, sf_dir), fx.PERSONA, fx.RULES_TEXT)


def infer_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir, fx.sessions(spark, sf_dir))


def generation_inputs(spark, sf_dir):
    last = curate.last_turn(fx.sessions(spark, sf_dir)).select("session_id", "query")
    made = responder.generation_inputs(infer_prompt(spark, sf_dir).join(last, "session_id"), tensorprep.word_tokenizer())
    return made.select("session_id", F.md5("input_text").alias("input_md5"), _text(F.transform("input_ids", lambda x: x.cast("string"))).alias("input_ids"))


def responses(spark, sf_dir):
    return responder.respond(infer_prompt(spark, sf_dir))


def catalog_miss(spark, sf_dir):
    t = curate.first_turn(fx.sessions(spark, sf_dir)).select("session_id", "music_id")
    known = fx.tracks(spark, sf_dir).select("track_id")
    miss = t.join(known, F.col("music_id") == F.col("track_id"), "left_anti").withColumn("known", F.lit(False))
    hit = t.join(known, F.col("music_id") == F.col("track_id"), "left_semi").withColumn("known", F.lit(True))
    return miss.unionByName(hit)


MAX_LENGTH, PAD, BATCH, SEED = 2048, 0, 8, 42


def _tokens(spark, sf_dir):
    t = curate.first_turn(fx.sessions(spark, sf_dir)).where("user_query is not null and assistant_raw is not null")
    rows = t.select(F.col("session_id"), F.lit("Be brief.").alias("system_prompt"), "user_query", F.col("assistant_raw").alias("assistant_response"))
    return tensorprep.masked(tensorprep.templated(rows), tensorprep.word_tokenizer(), MAX_LENGTH)


def _as_text(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[_text(F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def masked_tokens(spark, sf_dir):
    return _as_text(tensorprep.learnable(_tokens(spark, sf_dir)), "session_id")


def mask_drop_counts(spark, sf_dir):
    return tensorprep.mask_counts(_tokens(spark, sf_dir))


def padded_batches(spark, sf_dir):
    rows = tensorprep.learnable(_tokens(spark, sf_dir))
    return _as_text(tensorprep.padded(tensorprep.batched(rows, "session_id", BATCH, SEED), F.col("batch"), PAD), "session_id", "batch")


def eval_split(spark, sf_dir):
    return tensorprep.eval_split(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.02, 42)


ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def row_counts(spark, sf_dir):
    spec = {t: tables.TableSpec(f"{t}.parquet", split="role" if t == "conversations" else "lang" if t == "documents" else None) for t in ALL}
    return tables.Registry(spec, sf_dir).counts(spark)


def dimension_last(spark, sf_dir):
    """A keyed dimension: of the suppliers of a nation the last one's name, at the first one's place."""
    s = fx.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("ordinal"), "s_name")
    return tables.keyed(s, "key", "ordinal")


def _predictions(spark, sf_dir):
    """ordinal, raw: predictions of the benchmark's items as JSON, some broken in each way."""
    found = bm25.hit_lists(bm25.search(_index(spark, sf_dir), fx.read(spark, sf_dir, "benchmark"), "item_id", "text", TOP))
    q = F.col("qid")
    ids = F.transform("hits", lambda x: x.cast("string"))
    ids = F.when(q % 10 == 1, F.slice(ids, 1, 19)).when(q % 10 == 2, F.concat(F.slice(ids, 1, 19), F.slice(ids, 1, 1))).otherwise(ids)
    turn = F.when(q % 10 == 3, F.lit('"1"')).when(q % 10 == 7, F.lit("null")).otherwise(F.lit("1"))
    body = F.when(q % 10 == 4, F.lit("  ")).otherwise(F.lit("Try it."))
    user = F.when(q % 10 == 5, F.lit("")).otherwise(F.lit('"user_id": "u", '))
    session = F.when(q % 10 == 6, q - 1).otherwise(q).cast("string")
    raw = F.concat(F.lit('{"session_id": "'), session, F.lit('", '), user, F.lit('"turn_number": '), turn, F.lit(', "predicted_track_ids": '), F.to_json(ids), F.lit(', "predicted_response": "'), body, F.lit('"}'))
    return found.select(q.cast("long").alias("ordinal"), raw.alias("raw"))


def violations(spark, sf_dir):
    return validate.violations(_predictions(spark, sf_dir))


def _odd_predictions(spark, sf_dir):
    """A prediction for each document, every twelfth of a kind: nested and repeated names, escapes, values of other types."""
    d, q = F.col("doc_id"), F.col("doc_id").cast("string")
    ids = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), ", ")
    by = lambda cases, other: F.coalesce(*[F.when(d % 12 == k, F.lit(v) if isinstance(v, str) else v) for k, v in cases.items()], F.lit(other) if isinstance(other, str) else other)
    session = by({5: F.concat(F.lit('"'), (d - 5).cast("string"), F.lit('"')), 11: (d - 11).cast("string")}, F.concat(F.lit('"'), q, F.lit('"')))
    turn = by({2: '"\\u0074urn_number": 1', 3: '"turn_number": "x", "turn_number": 1', 4: '"turn_number": 1, "turn_number": "x"', 5: '"turn_number": true', 6: '"turn_number": 1.5'}, '"turn_number": 1')
    said = by({7: '{"predicted_response": "hi"}'}, '"a \\"predicted_response\\": 5"')
    tracks = by({8: F.concat(F.lit('{"ids": ['), ids, F.lit("]}")), 9: F.concat(F.lit("["), F.regexp_replace(ids, '"20"', "1"), F.lit("]"))}, F.concat(F.lit("["), ids, F.lit("]")))
    first = by({1: '"meta": {"turn_number": "x", "predicted_response": 7, "predicted_track_ids": []}, '}, "")
    raw = F.concat(F.lit("{"), first, F.lit('"predicted_response": '), said, F.lit(', "predicted_track_ids": '), tracks, F.lit(', "user_id": null, '), turn, F.lit(', "session_id": '), session, F.lit("}"))
    return fx.read(spark, sf_dir, "documents").select(d.alias("ordinal"), F.when(d % 12 == 10, F.lit('[1, "x"]')).otherwise(raw).alias("raw"))


def violations_any_shape(spark, sf_dir):
    return validate.violations(_odd_predictions(spark, sf_dir))


def hot_track_join(spark, sf_dir):
    """Lines of orders as plays, two fifths of them of one track, some unknown or null, joined with a catalog that isn't broadcast."""
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    track = F.when(n % 5 < 2, F.lit("7")).when(n % 97 == 3, F.lit("no such track")).when(n % 89 != 5, F.col("l_partkey").cast("string"))
    plays = fx.read(spark, sf_dir, "lineitem").select(n.alias("play"), line.alias("nth"), track.alias("music_id"))
    tracks = fx.tracks(spark, sf_dir).select("track_id", F.get("track_name", F.lit(0)).alias("name"))
    return dimension.join_dimension(plays, tracks, "music_id", "track_id", few=0).drop("track_id")


def first_violation(spark, sf_dir):
    return validate.first_violation(validate.violations(_predictions(spark, sf_dir)))


def head_limit(spark, sf_dir):
    """max_rows: the first n rows, none for 0; subset: the first n rows, all for 0."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id")
    out = None
    for name, n in (("max_rows_0", 0), ("max_rows_7", 7), ("subset_0", 0 or None), ("subset_7", 7 or None)):
        held = runner.head(d, n, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
        out = held if out is None else out.unionByName(held)
    return out


def json_roundtrip(spark, sf_dir):
    """Predictions written as one JSON list and read again. Driver-side: the result of a few queries."""
    rows = _predictions(spark, sf_dir).select(F.from_json("raw", tables.PREDICTIONS).alias("p")).select("p.*")
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/prediction.json"
        tables.write_json_array(rows, path, ["session_id", "predicted_response", "user_id", "turn_number"])
        with open(path, encoding="utf-8") as f:
            back = json.load(f)
    return spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False, sort_keys=True)) for i, x in enumerate(back)], "ordinal long, raw string")


def zip_listing(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        tables.write_json_array(_predictions(spark, sf_dir).select("raw"), f"{folder}/p.json", ["raw"])
        return spark.createDataFrame([(n,) for n in tables.write_zip(f"{folder}/p.json", f"{folder}/p.zip")], "member string")


# --- DuckDB ---------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in bm25.STOPWORDS)


def _bm25_sql(queries: str, k: int, corpus: str = "select doc_id as doc, text from documents") -> str:
    """CTEs up to `ranked`: qid, doc, score, rank. queries: SQL of (qid, text); corpus: of (doc, text)."""
    words = lambda t: f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w not in ({_STOP}))"
    return f"""
tok as (select doc, {words('text')} as w from ({corpus})),
lens as (select doc, len(w) as dl from tok),
post as (select doc, term, count(*) as tf from (select doc, unnest(w) as term from tok) group by all),
dfs as (select term, count(*) as df from post group by term),
st as (select count(*) as n_docs, avg(dl) as avgdl from lens),
q as ({queries}),
qt as (select qid, term, count(*) as qtf from (select qid, unnest({words('text')}) as term from q) group by all),
scored as (
  select qid, doc, sum(cast(qtf * (ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) as decimal(18,10))) as score
  from qt join post using (term) join dfs using (term) join lens using (doc), st group by qid, doc),
ranked as (
  select * from (select qid, doc, score, row_number() over (partition by qid order by score desc, doc) as rank from scored) where rank <= {k})"""


_RANKED = "select qid, doc as doc_id, round(cast(score as double), 6) as score, rank from ranked"
_ITEMS = "select item_id as qid, text from benchmark"
_WITH = "with "
#: The documents after the three changes of `_grown`.
_GROWN = "select doc_id as doc, case when doc_id % 50 = 0 then coalesce(text, '') || ' the text was changed ' || coalesce(text, '') else text end as text from documents where doc_id % 20 <> 3"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: \b next to any letter, for an engine whose \b knows ASCII alone.
_LEFT, _RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _default_rules() -> CurationRules:
    """The default patterns in DuckDB's syntax; two openers end in a space, and a word must follow."""
    whole = lambda p: _LEFT + p.removeprefix(r"\b").removesuffix(r"\b") + _RIGHT
    start = WARM_START.replace(r"right\s+(on)?|", r"right\s+on|").replace(r"here[’']?s\s+|", "").removesuffix(r"\b") + _RIGHT
    return CurationRules(banned=whole(BANNED), apology=whole(APOLOGY), hallucination=whole(HALLUCINATION), warm_anywhere=whole(WARM_ANYWHERE), warm_start=rf"({start}|^\s*(right\s+|here[’']?s\s+)[\p{{L}}\p{{N}}_])")


def _warm_sql(source: str, key: str, text: str, rules: CurationRules = RULES) -> str:
    """CTEs w0 to w4 of (key, x)."""
    out = [f"w0 as (select {key}, {_STRIP(text)} as x from {source})"]
    for i in range(4):
        out.append(f"""s{i} as (select {key}, x, regexp_extract(x, '^([\\s\\S]*?[.!?]["”’'']?(?:\\s+|$))', 1) as sent from w{i}),
w{i + 1} as (select {key}, case when sent <> '' and (regexp_matches({_STRIP('sent')}, {_quote('(?i)' + rules.warm_anywhere)}) or regexp_matches({_STRIP('sent')}, {_quote('(?i)' + rules.warm_start)})) then {_STRIP('substr(x, length(sent) + 1)')} else x end as x from s{i})""")
    return ",\n".join(out)


def _funnel_sql(rules: CurationRules = RULES, source: str = "triples") -> str:
    has = lambda p: f"regexp_matches(x, {_quote('(?i)' + p)})"
    tests = [
        "coalesce(user_query, '') = ''", "coalesce(t.music_id, '') = ''", "coalesce(assistant_raw, '') = ''", "name is null",
        f"lower({_STRIP('assistant_raw')}) in ('unknown message', '', 'none')",
        f"case when x = '' then 0 else len(regexp_split_to_array(x, '\\s+')) end < {rules.min_words}",
        has(rules.banned), has(rules.apology), has(rules.hallucination), f"not regexp_matches(x, {_quote(rules.citation)})",
        "right(regexp_replace(x, '\\s+$', ''), 1) not in (" + ", ".join(map(_quote, CLOSERS)) + ")",
    ]
    case = " ".join(f"when {t} then '{r}'" for t, r in zip(tests, REASONS, strict=True))
    return f"""{fx.TRACKS_SQL},
{fx.TRIPLES_SQL},
{fx.PHRASED_SQL},
{_warm_sql(source, 'session_id', 'assistant_raw', rules)},
judged as (select t.*, x, tracks.*, case {case} else 'kept' end as reason from {source} t join w4 using (session_id) left join tracks on t.music_id = track_id)"""


_HEAD = f"{_quote(fx.PERSONA.strip())} || chr(10) || chr(10) || {_quote(fx.RULES_TEXT.strip())}"
_ABOUT = """coalesce(chr(10) || chr(10) || '=== About this user ===' || chr(10) || nullif(concat_ws(chr(10), 'User profile (demographics): ' || profile, 'Conversation goal: ' || goal), ''), '')"""
_CANDIDATES = f"chr(10) || chr(10) || {_quote(CANDIDATES_HEAD)}"


def _sft_sql() -> str:
    return f"""with {_funnel_sql()}, {fx.USERS_SQL}
select session_id || '_t1' as session_id, user_query, music_id, {_HEAD} || {_ABOUT} || {_CANDIDATES} || '1. ' || {fx.LINE} as system_prompt, x as assistant_response
from judged left join users using (user_id) where reason = 'kept'"""


def _infer_sql() -> str:
    return f"""with {fx.TRACKS_SQL}, {fx.USERS_SQL}, ss as (select distinct conv_id as s from conversations where role <> 'system'),
picks as (select s, r, cast((s * 37 + r * 600) % 2500 as varchar) as track_id from ss, (select unnest([1, 2, 3]) as r)),
known as (select s, row_number() over (partition by s order by r) as i, {fx.LINE} as line from picks join tracks using (track_id)),
shown as (select s, string_agg(i || '. ' || line, chr(10) order by i) as body from known group by s),
held as (select s, profile, case when s % 3 = 0 then 'mood ' || s end as goal, coalesce(body, '') as body from ss left join shown using (s) left join users on user_id = cast(s * 11 % 2000 as varchar))
select cast(s as varchar) as session_id, {_HEAD} || {_ABOUT} || {_CANDIDATES} || body as system_prompt from held"""


_PIVOT = "arg_min(content, pos) filter (where role = '{0}' and turn_number = 1)"
_LINES = """lines as (select s, pos, case when role = 'music' then 'assistant: ' || coalesce({0}, content) else role || ': ' || content end as line from messages left join tracks on role = 'music' and content = track_id),
transcript as (select cast(s as varchar) as session_id, string_agg(line, chr(10) order by pos) as transcript from lines group by s)""".format(fx.META)


#: The corpus text of a track; the transcripts of sessions whose track is known.
_CORPUS = "'track_name: ' || name || chr(10) || 'artist_name: ' || artist || chr(10) || 'album_name: ' || album || chr(10) || 'release_date: ' || release || chr(10)"
_KNOWN = f"select session_id as qid, transcript as text from transcript where session_id in (select cast(s as varchar) from messages group by s having {_PIVOT.format('music')} in (select track_id from tracks))"


def _ids(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[^ \\n]+'), lambda w: cast(('0x' || substr(md5(w), 1, 8)) as bigint) % 50000)"


def _tokens_sql() -> str:
    ids = _ids
    return f"""{fx.MESSAGES_SQL},
t as (select cast(s as varchar) as session_id, {_PIVOT.format('user')} as u, {_PIVOT.format('assistant')} as a from messages group by s),
pre as (select session_id, a, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) as p from t where u is not null and a is not null),
ids as (select session_id, {ids("p || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10)")}[1:{MAX_LENGTH}] as input_ids, least(len({ids("p || '<|im_start|>assistant' || chr(10)")}[1:{MAX_LENGTH}]), len({ids("p || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' || chr(10)")}[1:{MAX_LENGTH}])) as n from pre),
rows as (select session_id, input_ids, list_transform(input_ids, lambda x: 1) as attention_mask, list_transform(input_ids, lambda x, i: case when i <= n then -100 else x end) as labels, len(input_ids) > n as learns from ids)"""


def oracle_sql() -> dict[str, str]:
    join = "array_to_string({0}, ',')"
    fill = lambda c, v: f"array_to_string(list_concat({c}, list_transform(range(most - len(input_ids)), lambda x: {v})), ',')"
    count = lambda t, s="'all'": f"select '{t}' as table_name, {s} as split, count(*) as n from {t} group by all"
    preds = f"""{_bm25_sql(_ITEMS, TOP)},
lists as (select qid, list(cast(doc as varchar) order by rank) as hits from ranked group by qid),
pred as (
  select qid, case when qid % 10 = 6 then qid - 1 else qid end as s, qid % 10 as m,
    case when qid % 10 = 1 then hits[1:19] when qid % 10 = 2 then list_concat(hits[1:19], hits[1:1]) else hits end as ids from lists),
bad as (
  select -1 as ordinal, 'V02' as rule from pred having count(*) <> 80
  union all select qid, 'V03' from pred where m = 5
  union all select qid, 'V04' from pred where m in (3, 7)
  union all select qid, 'V05' from pred where len(ids) <> 20
  union all select qid, 'V06' from pred where len(list_distinct(ids)) <> 20
  union all select qid, 'V07' from pred where m = 4
  union all select qid, 'V08' from (select qid, row_number() over (partition by s order by qid) as n from pred) where n > 1)"""
    last = f"with {fx.MESSAGES_SQL} select cast(s as varchar) as session_id, cast(arg_max(turn_number, pos) as integer) as turn_number from messages group by s"
    texts = f"with {fx.TRACKS_SQL}, {fx.MESSAGES_SQL}, {_LINES} select session_id, transcript from transcript"
    said = f"""select session_id, case when line = '' then {_quote(responder.EMPTY_RESPONSE)} else 'Try ' || line || '.' end as predicted_response
from (select session_id, regexp_extract(system_prompt, '\\n1\\. ([^\\n]*)', 1) as line from ({_infer_sql()}))"""
    return {
        "prediction_records": f"select * from ({last}) join ({texts}) using (session_id) join ({said}) using (session_id)",
        "mixed_goals": r"""select cast(p_partkey as varchar) as track_id, case p_partkey % 7 when 0 then p_name
    when 1 then '{''mood'': {''name'': ''' || p_name || ''', ''of'': [' || p_size || ', None, True, "it''s"]}, ''é'': ' || cast(round(p_partkey / 8, 3) as varchar) || '}'
    when 2 then '[[' || p_size || '], {}, '''']' when 3 then cast(p_size as varchar) when 5 then 'False' end as goal from part""",
        "bm25_top20": f"with {_bm25_sql(_ITEMS, TOP)} {_RANKED}",
        "bm25_stats": f"with {_bm25_sql(_ITEMS, TOP)} select n_docs, round(avgdl, 6) as avgdl, (select count(*) from dfs) as n_terms, (select cast(sum(df) as bigint) from dfs) as n_postings from st",
        "violations_any_shape": """with k as (select doc_id as ordinal, doc_id % 12 as k from documents)
select cast(-1 as bigint) as ordinal, 'V02' as rule from k having count(*) <> 80
union all select ordinal, unnest(['V03', 'V05', 'V06', 'V07']) from k where k = 10
union all select ordinal, 'V04' from k where k in (4, 6)
union all select ordinal, unnest(['V05', 'V06']) from k where k = 8
union all select ordinal, 'V07' from k where k = 7
union all select b.ordinal, 'V08' from k b join k a on b.k = 5 and a.ordinal = b.ordinal - 5""",
        "hot_track_join": """with plays as (select l_orderkey as play, l_linenumber as nth,
    case when l_orderkey % 5 < 2 then '7' when l_orderkey % 97 = 3 then 'no such track' when l_orderkey % 89 <> 5 then cast(l_partkey as varchar) end as music_id from lineitem)
select play, nth, music_id, p_name as name from plays left join part on music_id = cast(p_partkey as varchar)""",
        "bm25_growing_top20": f"with {_bm25_sql(_ITEMS, TOP, _GROWN)} {_RANKED}",
        "bm25_growing_stats": f"with {_bm25_sql(_ITEMS, TOP, _GROWN)} select state, n_docs, round(avgdl, 6) as avgdl, (select count(*) from dfs) as n_terms, (select cast(sum(df) as bigint) from dfs) as n_postings from st, (select unnest(['segments', 'compacted']) as state)",
        "bm25_zero_fill": f"""with {_bm25_sql("select item_id as qid, case when item_id % 2 = 0 then 'qqqqzzzz' else regexp_extract(text, '\\S+\\s*$') end as text from benchmark", TOP)},
filled as (select q.qid, l.doc, coalesce(s.score, 0) as score from q cross join lens l left join scored s on s.qid = q.qid and s.doc = l.doc)
select qid, doc as doc_id, round(cast(score as double), 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from filled) where rank <= {TOP}""",
        "bm25_transcript_top20": f"with {fx.TRACKS_SQL}, {fx.MESSAGES_SQL}, {_LINES}, {_bm25_sql('select session_id as qid, transcript as text from transcript', TOP)} {_RANKED}",
        "ordered_dedupe_top3": f"with {_bm25_sql(_ITEMS, DEEP)} select qid, string_agg(cast(doc as varchar), ',' order by rank) filter (where rank <= {TOP}) as hits, string_agg(cast(doc as varchar), ',' order by rank) filter (where rank <= {FIRST}) as top3 from ranked group by qid",
        "bm25_catalog_top20": f"with {fx.TRACKS_SQL}, {fx.MESSAGES_SQL}, {_LINES}, {_bm25_sql(_KNOWN, TOP, f'select track_id as doc, {_CORPUS} as text from tracks')} select qid, doc as track_id, round(cast(score as double), 6) as score, rank from ranked",
        "strict_transcript": f"with {fx.TRACKS_SQL}, {fx.MESSAGES_SQL}, {_LINES} select qid as session_id, text as transcript from ({_KNOWN})",
        "funnel_default_lexicon": f"with {_funnel_sql(_default_rules(), 'phrased')} select session_id, reason, md5(x) as cleaned_md5 from judged",
        "scalar_track_lines": """select cast(p_partkey as varchar) as track_id, '"' || p_name || '" by ' || p_brand || ' (' || case when p_partkey % 2 = 1 then p_type || ', ' else '' end || (p_size + 1990) || ')' || case when p_partkey % 2 = 1 then ' [tags: ' || p_type || ']' else '' end as line from part""",
        "dict_goals": fx.GOALS_SQL,
        "sample_preview": f"select left(user_query, 200) as user_query, music_id, left(assistant_response, 300) as assistant_response from ({_sft_sql()}) order by session_id limit 1",
        "generation_inputs": f"""with asked as (with {fx.MESSAGES_SQL} select cast(s as varchar) as session_id, arg_max(content, pos) as query from messages group by s),
shown as (select session_id, '<|im_start|>system' || chr(10) || system_prompt || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || query || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as t from ({_infer_sql()}) join asked using (session_id))
select session_id, md5(t) as input_md5, array_to_string({_ids('t')}[1:3072], ',') as input_ids from shown""",
        "responses": said,
        "json_roundtrip": f"""with {preds},
said as (select cast(s as varchar) as s, ids, case when m = 4 then '  ' else 'Try it.' end as body, case when m in (3, 7) then null else 1 end as turn, case when m = 5 then null else 'u' end as u from pred)
select row_number() over (order by s, body, u nulls first, turn nulls first) - 1 as ordinal,
  '{{"predicted_response": "' || body || '", "predicted_track_ids": [' || array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ', ') || '], "session_id": "' || s || '", "turn_number": ' || coalesce(cast(turn as varchar), 'null') || ', "user_id": ' || coalesce('"' || u || '"', 'null') || '}}' as raw from said""",
        "zip_listing": "select 'prediction.json' as member",
        "turn1_pivot": f"with {fx.MESSAGES_SQL} select cast(s as varchar) || '_t1' as session_id, {_PIVOT.format('user')} as user_query, {_PIVOT.format('music')} as music_id, {_PIVOT.format('assistant')} as assistant_raw from messages group by s",
        "last_turn": f"with {fx.MESSAGES_SQL} select cast(s as varchar) as session_id, arg_max(content, pos) as query, cast(arg_max(turn_number, pos) as integer) as turn_number, arg_max(role, pos) = 'user' as is_user from messages group by s",
        "transcript": f"with {fx.TRACKS_SQL}, {fx.MESSAGES_SQL}, {_LINES} select session_id, transcript from transcript",
        "warm_strip": f"with {_warm_sql('documents', 'doc_id', 'text')} select doc_id, x as stripped from w4",
        **dict.fromkeys(("funnel_stats", "observed_funnel", "streamed_funnel"), f"with {_funnel_sql()} select count(*) as total_sessions, " + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in [*REASONS, "kept"]) + " from judged"),
        "funnel_reason_rows": f"with {_funnel_sql()} select session_id, reason from judged",
        "streamed_reason_rows": f"with {_funnel_sql()} select session_id, reason from judged",
        "sft_rows": _sft_sql(),
        "train_prompt": f"select session_id, md5(system_prompt) as prompt_md5, cast(length(system_prompt) as integer) as prompt_length from ({_sft_sql()})",
        "infer_prompt": _infer_sql(),
        "track_lines": f"with {fx.TRACKS_SQL} select track_id, {fx.LINE} as line from tracks",
        "metadata_text": f"with {fx.TRACKS_SQL} select track_id, {fx.META} as metadata from tracks",
        "corpus_text": f"with {fx.TRACKS_SQL} select track_id, 'track_name: ' || name || chr(10) || 'artist_name: ' || artist || chr(10) || 'album_name: ' || album || chr(10) || 'release_date: ' || release || chr(10) as corpus from tracks",
        "profile_text": f"with {fx.USERS_SQL} select user_id, profile from users",
        "catalog_miss": f"with {fx.MESSAGES_SQL}, t as (select s, {_PIVOT.format('music')} as music_id from messages group by s) select cast(s as varchar) as session_id, music_id, p_partkey is not null as known from t left join part on music_id = cast(p_partkey as varchar)",
        "masked_tokens": f"with {_tokens_sql()} select session_id, {join.format('input_ids')} as input_ids, {join.format('attention_mask')} as attention_mask, {join.format('labels')} as labels from rows where learns",
        "mask_drop_counts": f"with {_tokens_sql()} select count(*) as before, count(*) filter (where learns) as after, count(*) filter (where not learns) as dropped from rows",
        "padded_batches": f"with {_tokens_sql()}, b as (select *, cast(floor((row_number() over (order by md5('{SEED}:' || session_id), session_id) - 1) / {BATCH}) as bigint) as batch from rows where learns), m as (select *, max(len(input_ids)) over (partition by batch) as most from b) select session_id, batch, {fill('input_ids', PAD)} as input_ids, {fill('attention_mask', 0)} as attention_mask, {fill('labels', -100)} as labels from m",
        "eval_split": "select doc_id, case when row_number() over (order by md5('42:' || doc_id), doc_id) <= (select case when count(*) >= 50 then ceil(count(*) * 0.02e0) else 0 end from documents) then 'eval' else 'train' end as split from documents",
        "row_counts": " union all ".join(count(t, "role" if t == "conversations" else "lang" if t == "documents" else "'all'") for t in ALL),
        "dimension_last": "select s_nationkey as key, min(s_suppkey) as ordinal, arg_max(s_name, s_suppkey) as s_name from supplier group by all",
        "violations": f"with {preds} select cast(ordinal as bigint) as ordinal, rule from bad",
        "first_violation": f"with {preds} select cast(ordinal as bigint) as ordinal, rule from bad order by ordinal, rule limit 1",
        "head_limit": "with d as (select doc_id from documents order by doc_id limit 7) select 'max_rows_0' as name, 0 as n, 0 as ids union all select 'max_rows_7', count(*), cast(sum(doc_id) as bigint) from d union all select 'subset_0', count(*), cast(sum(doc_id) as bigint) from documents union all select 'subset_7', count(*), cast(sum(doc_id) as bigint) from d",
    }


def queries() -> dict:
    return {
        "bm25_top20": bm25_top20, "bm25_stats": bm25_stats, "bm25_zero_fill": bm25_zero_fill, "bm25_transcript_top20": bm25_transcript_top20, "bm25_catalog_top20": bm25_catalog_top20,
        "violations_any_shape": violations_any_shape, "hot_track_join": hot_track_join, "mixed_goals": mixed_goals, "prediction_records": prediction_records,
        "observed_funnel": observed_funnel, "streamed_funnel": streamed_funnel, "streamed_reason_rows": streamed_reason_rows,
        "bm25_growing_top20": bm25_growing_top20, "bm25_growing_stats": bm25_growing_stats,
        "strict_transcript": strict_transcript, "funnel_default_lexicon": funnel_default_lexicon, "scalar_track_lines": scalar_track_lines, "dict_goals": dict_goals, "sample_preview": sample_preview, "generation_inputs": generation_inputs,
        "ordered_dedupe_top3": ordered_dedupe_top3, "turn1_pivot": turn1_pivot, "last_turn": last_turn, "transcript": transcript, "warm_strip": warm_strip,
        "funnel_stats": funnel_stats, "funnel_reason_rows": funnel_reason_rows, "sft_rows": sft_rows, "track_lines": track_lines, "metadata_text": metadata,
        "corpus_text": corpus, "profile_text": profiles, "train_prompt": train_prompt, "infer_prompt": infer_prompt, "responses": responses, "catalog_miss": catalog_miss,
        "masked_tokens": masked_tokens, "mask_drop_counts": mask_drop_counts, "padded_batches": padded_batches, "eval_split": eval_split, "row_counts": row_counts,
        "dimension_last": dimension_last, "violations": violations, "first_violation": first_violation, "head_limit": head_limit, "json_roundtrip": json_roundtrip, "zip_listing": zip_listing,
    }
