"""A stored BM25 index that grows: segments of documents, with what each of them replaces or deletes.

A change writes a segment of its own: its documents' words, their document frequencies and sums, and the documents
that are gone from all earlier segments (those it deletes and those it has anew). It counts once a manifest names it. Manifests
are numbered and published by renaming, so that readers see one state or the next, a change that fails half-way leaves no trace but
files that no manifest names, and of two changes made at once the second is refused.

Statistics are merged: the segments' sums and frequencies less those of the documents that are gone, which alone are looked at. compact() writes
all that lives into one segment; vacuum() deletes what the last manifest doesn't name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.operators import bm25
from sparkvane.sources import store

#: Rows (a document id each) of what is gone that are broadcast at most; beyond, joins shuffle.
FEW = 1_000_000


@dataclass
class Segment:
    name: str
    n_docs: int
    n_gone: int


@dataclass
class State:
    version: int = 0
    params: str = ""
    segments: list[Segment] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another change was published since the state that this one began with."""


class GrowingIndex:
    """An index in a folder that all executors see. Its parameters are those it was begun with."""

    def __init__(self, spark: SparkSession, path: str, params: bm25.BM25Params = bm25.BM25Params()):
        self.spark, self.path, self.params = spark, path, params
        if (found := self.state()).params not in ("", self._params()):
            raise ValueError(f"the index at {path} was made with {found.params}")

    def _params(self) -> str:
        return json.dumps(asdict(self.params))

    def state(self) -> State:
        """What the last manifest says."""
        whole = [n for n in store.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not whole:
            return State()
        said = json.loads(store.read_text(self.spark, f"{self.path}/manifests/{whole[-1]}"))
        return State(said["version"], said["params"], [Segment(**s) for s in said["segments"]])

    def _publish(self, before: State, segments: list[Segment]) -> None:
        after = State(before.version + 1, self._params(), segments)
        if not store.publish(self.spark, f"{self.path}/manifests/{after.version:012d}.json", json.dumps(asdict(after))):
            raise Conflict(f"version {after.version} of {self.path} is taken")

    def _table(self, segment: Segment | str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{getattr(segment, 'name', segment)}/{name}")

    def _written(self, held: DataFrame, gone: DataFrame | None) -> Segment:
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        held.write.parquet(f"{at}/held")
        held = self._table(name, "held")
        bm25.document_frequencies(held).write.parquet(f"{at}/df")
        bm25.sums(held).write.parquet(f"{at}/sums")
        ids = held.select("doc") if gone is None else held.select("doc").union(gone.select(F.col("doc").cast(held.schema["doc"].dataType)))
        ids.distinct().write.parquet(f"{at}/gone")
        return Segment(name, self._table(name, "sums").first()["n_docs"], self._table(name, "gone").count())

    def add(self, corpus: DataFrame, doc: str, text: str, deleted: DataFrame | None = None) -> None:
        """Documents that are new, or replace those of the same key, and keys (column `doc`) of documents to delete. `doc` is a key of the corpus."""
        before = self.state()
        self._publish(before, [*before.segments, self._written(bm25.held(corpus, doc, text, self.params), deleted)])

    def delete(self, deleted: DataFrame) -> None:
        """Keys (column `doc`) of documents to delete; unknown ones change nothing."""
        if kept := self.state().segments:
            empty = self._table(kept[0], "held").limit(0)
            self.add(empty.select("doc", F.lit("").alias("text")), "doc", "text", deleted)

    def _parted(self, segments: list[Segment]) -> list[tuple[Segment, DataFrame, DataFrame | None]]:
        """Each segment's living documents, and those that a later one has or deletes (None if there is none)."""
        out = []
        for i, segment in enumerate(segments):
            held, later = self._table(segment, "held"), [s for s in segments[i + 1 :] if s.n_gone]
            if not later or not segment.n_docs:
                out.append((segment, held, None))
                continue
            gone = self._table(later[0], "gone")
            for s in later[1:]:
                gone = gone.union(self._table(s, "gone"))
            gone = F.broadcast(gone) if sum(s.n_gone for s in later) <= FEW else gone
            out.append((segment, held.join(gone, "doc", "left_anti"), held.join(gone, "doc", "left_semi")))
        return out

    def index(self) -> bm25.Index | None:
        """The living documents and the merged statistics, or None before the first change."""
        if not (segments := self.state().segments):
            return None
        parts = self._parted(segments)
        live, df, sums = parts[0][1], None, None
        for _, alive, _ in parts[1:]:
            live = live.unionByName(alive)
        minus = lambda rows, *columns: rows.select(*[(-F.col(c)).alias(c) if c in columns else c for c in rows.columns])
        for segment, _, dead in parts:
            some = [(self._table(segment, "df"), self._table(segment, "sums"))]
            some += [(minus(bm25.document_frequencies(dead), "df"), minus(bm25.sums(dead), "n_docs", "words"))] if dead is not None else []
            for d, s in some:
                df, sums = (d, s) if df is None else (df.unionByName(d), sums.unionByName(s))
        df = df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        stats = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
        return bm25.Index(live, df, stats.select("n_docs", (F.col("words") / F.greatest("n_docs", F.lit(1))).alias("avgdl")), self.params)

    def compact(self) -> None:
        """One segment in place of all; queries that began before go on with the old ones until vacuum()."""
        before = self.state()
        if len(before.segments) > 1:
            live = None
            for _, alive, _ in self._parted(before.segments):
                live = alive if live is None else live.unionByName(alive)
            self._publish(before, [self._written(live, None)])

    def vacuum(self) -> list[str]:
        """Deletes segments and manifests that aren't in use any more; their names. No change may be under way."""
        now = self.state()
        named = {s.name for s in now.segments}
        old = [f"segments/{n}" for n in store.names(self.spark, f"{self.path}/segments") if n not in named]
        old += [f"manifests/{n}" for n in store.names(self.spark, f"{self.path}/manifests") if n != f"{now.version:012d}.json"]
        for name in old:
            store.remove(self.spark, f"{self.path}/{name}")
        return old
