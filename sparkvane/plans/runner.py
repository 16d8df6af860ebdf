"""The engine end to end: curated rows, token rows for a trainer, predictions, the package. Each stage can be skipped.

A stage that is done leaves a manifest with a fingerprint of its settings, its source files and the stages before it. A run that
resumes leaves out the stages whose fingerprint is still the same; a stage that was changed, or broke off, is done again, and so is what depends on it.

Tables of the registry: train_sessions, test_sessions, tracks, users (optional). Their ids are unique, or
a column `ordinal` tells which row came last. "First" sessions are those with the least session_id.
What stages hand on lies under `work`, in any store that Spark writes to; the JSON list and its zip, the
result of one test set, go to `output`, a folder of the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.rules import CurationRules
from sparkvane.functions.text import corpus_text
from sparkvane.operators import bm25, curate, prompts, records, responder, tensorprep, training, validate
from sparkvane.sources import store, tables
from sparkvane.sources.observed import write_observed

SPECS = {
    "train_sessions": tables.TableSpec("train_sessions.parquet", tables.SESSIONS),
    "test_sessions": tables.TableSpec("test_sessions.parquet", tables.SESSIONS),
    "tracks": tables.TableSpec("tracks.parquet", tables.TRACKS),
    "users": tables.TableSpec("users.parquet", tables.USERS),
}


@dataclass(frozen=True)
class Settings:
    root: str
    work: str
    output: str
    base_model: str
    persona: str = ""
    rules_text: str = ""
    #: Text files that take the place of the two before, where they are named.
    persona_file: str = ""
    rules_file: str = ""
    #: First sessions of the training set: all for None, none for 0.
    max_rows: int | None = None
    #: First sessions of the test set: all for 0. A subset isn't packaged.
    subset: int = 0
    expected: int = 80
    depth: int = 40
    keep: int = 20
    shown: int = 3
    max_length: int = 2048
    max_input: int = 3072
    eval_fraction: float = 0.02
    seed: int = 42
    targets: str = "attn"
    #: The trained adapter; where it is named it must exist before predictions are made.
    adapter: str = ""
    skip: tuple[str, ...] = ()

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ, **given) -> Settings:
        """Fields from SPARKVANE_<FIELD>; what is given in code wins. skip is a list with commas."""
        read: dict = {}
        for f in fields(cls):
            if (text := env.get(f"SPARKVANE_{f.name.upper()}")) and f.name not in given:
                read[f.name] = tuple(filter(None, text.split(","))) if f.name == "skip" else int(text) if f.type in ("int", "int | None") else float(text) if f.type == "float" else text
        return cls(**read, **given)


@dataclass
class Run:
    """What the stages of one run share."""

    spark: SparkSession
    settings: Settings
    rules: CurationRules = field(default_factory=CurationRules)
    tokenizer: tensorprep.Tokenizer = field(default_factory=tensorprep.word_tokenizer)
    generate: responder.Generate = responder.template_responder
    #: Names the tokenizer and the responder, whose code no fingerprint can tell.
    code: str = ""

    def path(self, name: str) -> str:
        return f"{self.settings.work}/{name}"

    @property
    def registry(self) -> tables.Registry:
        return tables.Registry(SPECS, self.settings.root)

    def dimension(self, key: str, by: str) -> DataFrame:
        df = self.registry.optional(self.spark, key) if key == "users" else self.registry.scan(self.spark, key)
        return tables.keyed(df, by, "ordinal").drop("ordinal") if "ordinal" in df.columns else df


#: Rows that are brought into one task at most, to find the first of all.
TOP = 100_000


def head(df: DataFrame, n: int | None, key: str = "session_id") -> DataFrame:
    """The n rows with the least keys, or all for None. Of many, the range of keys where the n-th lies is found by counts, and it alone is sorted in one task."""
    if n is None or n <= TOP:
        return df if n is None else df.orderBy(key).limit(n)
    placed = store.stored(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), store.scratch(df.sparkSession))
    before = 0
    for part, count in placed.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        if before + count >= n:
            last = placed.where(F.col("__range") == part).orderBy(key).limit(n - before)
            return placed.where(F.col("__range") < part).unionByName(last).drop("__range")
        before += count
    return df


def prompt_texts(run: Run) -> tuple[str, str]:
    s = run.settings
    return tuple(tables.read_text(run.spark, f) if f else t for f, t in ((s.persona_file, s.persona), (s.rules_file, s.rules_text)))


#: Characters that a preview shows of a field.
PREVIEW = {"user_query": 200, "assistant_response": 300}


def sample(rows: DataFrame) -> DataFrame:
    """One row of those for fine-tuning, cut short."""
    return tables.preview(head(rows, 1).select("user_query", "music_id", "assistant_response"), PREVIEW)


def one_row(run: Run, counted: dict[str, int], name: str) -> None:
    tables.write_table(run.spark.createDataFrame([tuple(counted.values())], ", ".join(f"{k} long" for k in counted)), run.path(name))


def dataset(run: Run) -> None:
    """Curated rows, a sample of them, and the funnel's counters. Rows are judged once, and counted by the job that writes them."""
    s = run.settings
    sessions = head(run.registry.scan(run.spark, "train_sessions"), s.max_rows)
    judged = curate.judged(curate.first_turn(sessions).drop("conversations"), run.dimension("tracks", "track_id"), run.rules)
    counted = write_observed(judged, run.path("judged"), **curate.funnel_counters())
    rows = run.spark.read.parquet(run.path("judged"))
    tables.write_table(curate.sft_rows(rows, run.dimension("users", "user_id"), *prompt_texts(run)), run.path("rows"))
    one_row(run, counted, "funnel")
    tables.write_table(sample(run.spark.read.parquet(run.path("rows"))), run.path("sample"))


def train(run: Run) -> None:
    """Token rows with their split, and the trainer's configuration. Training itself happens outside Spark."""
    s = run.settings
    rows = tensorprep.templated(run.spark.read.parquet(run.path("rows")))
    tokens = tensorprep.masked(rows, run.tokenizer, s.max_length).select("session_id", "input_ids", "attention_mask", "labels")
    n = write_observed(tokens, run.path("tokens"), tensorprep.has_label(), **tensorprep.mask_counters())
    one_row(run, n | {"dropped": n["before"] - n["after"]}, "masked")
    split = tensorprep.eval_split(run.spark.read.parquet(run.path("tokens")), "session_id", s.eval_fraction, s.seed)
    tables.write_table(split, run.path("split"))
    n = dict(run.spark.read.parquet(run.path("split")).groupBy("split").count().collect())  # two rows
    config = training.TrainingConfig(s.base_model, max_length=s.max_length, eval_fraction=s.eval_fraction, seed=s.seed, targets=s.targets)
    training.write_config(run.spark, config.exported(n.get("train", 0), n.get("eval", 0)), run.path("training"))


def index_of(run: Run, tracks: DataFrame) -> bm25.Index:
    """The stored index, made anew where there is none or the catalog is another one."""
    corpus = tracks.select("track_id", corpus_text({f: F.col(f) for f in prompts.FIELDS}).alias("text"))
    seen = corpus.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("track_id", "text").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    fingerprint, path = f"{seen['n']}:{seen['h']}", run.path("index")
    if (found := bm25.load(run.spark, path, fingerprint)) is None:
        bm25.save(bm25.build(corpus, "track_id", "text"), path, fingerprint)
        found = bm25.load(run.spark, path, fingerprint)
    return found


def inference(run: Run) -> None:
    """Predictions of the test sessions: retrieved tracks and a response."""
    s = run.settings
    sessions = head(run.registry.scan(run.spark, "test_sessions"), s.subset or None)
    # a prediction's key is session and turn; the stages between know it as session_id
    turn = F.element_at("conversations", -1)["turn_number"]
    sessions = sessions.withColumns({"name": F.col("session_id"), "turn_number": turn}).withColumn("session_id", F.concat_ws("#", "session_id", turn.cast("string")))
    tracks, users = run.dimension("tracks", "track_id"), run.dimension("users", "user_id")
    asked = prompts.transcripts(sessions, tracks).withColumn("transcript", F.lower("transcript"))
    found = bm25.search(index_of(run, tracks), asked, "session_id", "transcript", s.depth, zero_fill=True)
    tables.write_table(bm25.hit_lists(found, s.keep), run.path("hits"))
    hits = run.spark.read.parquet(run.path("hits"))
    picks = hits.select(F.col("qid").alias("session_id"), F.posexplode(F.slice("hits", 1, s.shown)).alias("pos", "track_id")).withColumn("rank", F.col("pos") + 1)
    last = curate.last_turn(sessions).drop("is_user")
    shown = prompts.inference_prompts(sessions, users, picks, tracks, *prompt_texts(run), s.shown).join(last, "session_id")
    said = responder.respond(responder.generation_inputs(shown, run.tokenizer, s.max_input), run.generate)
    ids = hits.select(F.col("qid").alias("session_id"), F.col("hits").alias("predicted_track_ids"))
    shelf = records.Shelf(run.spark, "session_id")
    rows = shelf.joined(shelf.put(sessions.select("session_id", "name", "user_id", "turn_number")), shelf.put(ids), shelf.put(said))
    tables.write_table(rows.select(F.col("name").alias("session_id"), "user_id", "turn_number", "predicted_track_ids", "predicted_response"), run.path("predictions"))
    shelf.drop()
    os.makedirs(s.output, exist_ok=True)
    tables.write_json_array(run.spark.read.parquet(run.path("predictions")), f"{s.output}/predictions.json", ["session_id", "turn_number"])


def package(run: Run) -> None:
    """The zip of a list that breaks no rule; the first broken one is an error."""
    s = run.settings
    raw = tables.read_raw_array(run.spark, f"{s.output}/predictions.json")
    if broken := validate.first_violation(validate.violations(raw, s.expected, s.keep)).first():
        raise ValueError(f"row {broken['ordinal']} breaks rule {broken['rule']}")
    tables.write_zip(f"{s.output}/predictions.json", f"{s.output}/prediction.zip")


STAGES: dict[str, Callable[[Run], None]] = {"dataset": dataset, "train": train, "inference": inference, "package": package}


@dataclass(frozen=True)
class Depends:
    """What a stage's results follow from, and which they are: settings, sources, stages before, tables and files."""

    settings: tuple[str, ...]
    sources: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


_TEXTS = ("root", "persona", "rules_text", "persona_file", "rules_file")
DEPENDS = {
    "dataset": Depends((*_TEXTS, "max_rows"), ("train_sessions", "tracks", "users"), tables=("judged", "rows", "funnel", "sample")),
    "train": Depends(("base_model", "max_length", "eval_fraction", "seed", "targets"), stages=("dataset",), tables=("tokens", "masked", "split", "training")),
    "inference": Depends((*_TEXTS, "subset", "depth", "keep", "shown", "max_input", "adapter", "output"), ("test_sessions", "tracks", "users"), tables=("hits", "predictions"), files=("predictions.json",)),
    "package": Depends(("expected", "keep", "output"), stages=("inference",), files=("prediction.zip",)),
}


def fingerprint(run: Run, stage: str) -> str:
    """Of all that the stage's results follow from; source files are told by their names, sizes and times."""
    s, need = run.settings, DEPENDS[stage]
    files = [(f"{s.root}/{SPECS[key].path}") for key in need.sources] + [getattr(s, f) for f in ("persona_file", "rules_file") if f in need.settings and getattr(s, f)]
    known = [stage, {f: getattr(s, f) for f in need.settings}, repr(run.rules), run.code, [fingerprint(run, b) for b in need.stages], [store.listing(run.spark, f) for f in files]]
    return hashlib.sha256(json.dumps(known, default=str).encode()).hexdigest()


def _manifest(run: Run, stage: str) -> str:
    return run.path(f"manifests/{stage}.json")


def is_done(run: Run, stage: str) -> bool:
    """Whether the stage's results are there, whole, and of what there is now."""
    need, at = DEPENDS[stage], _manifest(run, stage)
    if not store.exists(run.spark, at) or json.loads(store.read_text(run.spark, at))["fingerprint"] != fingerprint(run, stage):
        return False
    return all(store.exists(run.spark, run.path(f"{t}/_SUCCESS")) for t in need.tables) and all(os.path.exists(f"{run.settings.output}/{f}") for f in need.files)


def run_stages(run: Run, resume: bool = False) -> dict[str, str]:
    """What became of each stage: done, done before, or why it was skipped. Needs that aren't met are an error before the stage begins."""
    s, out = run.settings, {}
    if unknown := set(s.skip) - set(STAGES):
        raise ValueError(f"no stages of the names {sorted(unknown)}")
    needs = {"train": [run.path("rows")], "inference": [s.adapter] if s.adapter else []}
    for name, stage in STAGES.items():
        if name in s.skip:
            out[name] = "skipped: asked for"
        elif name == "package" and s.subset:
            out[name] = "skipped: a subset has too few rows"
        elif resume and is_done(run, name):
            out[name] = "done before"
        else:
            for path in needs.get(name, []):
                if not store.exists(run.spark, path):
                    raise FileNotFoundError(f"{name} needs {path}; run the stage that makes it first")
            store.remove(run.spark, _manifest(run, name))  # while it runs, and if it breaks off, it isn't done
            now = fingerprint(run, name)
            stage(run)
            store.publish(run.spark, _manifest(run, name), json.dumps({"fingerprint": now}))
            out[name] = "done"
    return out


def with_settings(run: Run, **changed) -> Run:
    return replace(run, settings=replace(run.settings, **changed))
