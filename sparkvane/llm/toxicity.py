"""Toxicity: a bag of subword embeddings, averaged, under a linear softmax; trained jointly in numpy.

A text is lower-cased, everything but letters and digits becomes a space, and its subwords are the
byte n-grams of MIN_N to MAX_N bytes of its words, a space marking either end of a word. Each is
hashed to one of 2**BITS embeddings, so that a misspelling shares most of its embeddings with the
word. A document is the average over all its subwords; embeddings and softmax are fitted together by Adam.
As the softmax is linear, scoring needs only each embedding's logit: a text costs a few table look-ups a byte.

The classifier is fitted on a bounded sample of labelled rows: at most max_toxic and max_clean of
them, those with the least hash of the id, but for texts of over max_chars characters (parameters), so that
one task can hold it. Scoring covers all whole texts.

Defined cases. A null or empty text, or one without letters or digits, has no subwords and gets the
score of the bias alone. Null labels are not used; of a repeated doc_id the greatest text and label
count. Without labelled rows of both classes every score is 0. Repeated rows get equal scores. An
empty table gives an empty result. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import freed, read

BITS, MIN_N, MAX_N, DIM = 17, 3, 6, 8
#: Every text also holds so many subwords that say nothing: a few words alone are weak evidence.
PAD = 200
#: Subwords of fewer training documents are left out.
MIN_DOCS = 8
#: Logits are SCALE times the average's.
SCALE = 20.0
#: Bytes of text that are looked at together.
TILE = 1 << 20
_SPACES = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def _plain(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_SPACES) + b" "


def _tiles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of several texts together, and where each begins. A text is never split."""
    held, starts, at = [], [], 0
    for t in texts:
        b = _plain(t)
        if held and at + len(b) > TILE:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(starts)
            held, starts, at = [], [], 0
        starts.append(at)
        held.append(b)
        at += len(b)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(starts)


def _grams(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: whether an n-gram of a word starts at a byte, and its bucket."""
    space = b == 32
    spaces = np.concatenate(([0], np.cumsum(space)))
    value = b.astype(np.uint64)
    for n in range(2, MAX_N + 1):
        value = (value[:-1] << np.uint64(8)) | b[n - 1 :]
        if n >= MIN_N:
            m = len(value)
            inside = spaces[n - 1 : m + n - 1] - spaces[1 : m + 1]  # spaces but at the ends
            good = inside == 0
            yield good, ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def score_texts(texts: list[str | None], logits: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for b, starts in _tiles(texts):
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        for good, bucket in _grams(b):
            pad = len(b) - len(good)
            total += np.add.reduceat(np.pad(np.where(good, logits[bucket], 0.0), (0, pad)), starts)
            count += np.add.reduceat(np.pad(good.astype(np.float64), (0, pad)), starts)
        out.append(1.0 / (1.0 + np.exp(-np.clip(SCALE * total / (count + PAD) + bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.02, decay: float = 1e-3, lasso: float = 0.2, seed: int = 0) -> tuple[np.ndarray, float]:
    """Each bucket's logit of label 1 against 0, and the bias."""
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(1 << BITS, np.int32)
    for t in texts:
        b = np.frombuffer(_plain(t), np.uint8)
        n = np.zeros(1 << BITS, np.int32)
        for good, bucket in _grams(b) if len(b) >= MAX_N else []:
            n += np.bincount(bucket[good], minlength=1 << BITS).astype(np.int32)
        ids = np.flatnonzero(n)
        seen[ids] += 1
        bags.append((ids.astype(np.int32), (n[ids] / (n.sum() + PAD)).astype(np.float32)))
    bags = [(i[k], w[k]) for i, w in bags for k in [seen[i] >= MIN_DOCS]]
    emb = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    emb[seen < MIN_DOCS] = 0.0  # what few documents hold says nothing
    soft, bias = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    m1, m2 = np.zeros_like(emb), np.zeros_like(emb)
    s1, s2, b1, b2 = np.zeros_like(soft), np.zeros_like(soft), np.zeros_like(bias), np.zeros_like(bias)
    step = 0

    def adam(p, g, a, v):
        a *= 0.9
        a += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            step += 1
            some = [bags[i] for i in order[k : k + batch]]
            y = labels[order[k : k + batch]]
            ids, of = np.concatenate([i for i, _ in some]), np.repeat(np.arange(len(some)), [len(i) for i, _ in some])
            w = np.concatenate([x for _, x in some]) * np.float32(SCALE)
            h = np.stack([np.bincount(of, w * emb[ids, d], len(some)) for d in range(DIM)], 1).astype(np.float32)
            z = h @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = p @ soft.T
            rows, at = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(at, w * back[of, d], len(rows)) for d in range(DIM)], 1).astype(np.float32) + np.float32(decay / len(y)) * emb[rows]
            pe, a, v = emb[rows], m1[rows], m2[rows]
            adam(pe, g, a, v)
            pe *= np.maximum(0, 1 - rate * lasso / (np.linalg.norm(pe, axis=1, keepdims=True) + 1e-9))  # few subwords matter
            emb[rows], m1[rows], m2[rows] = pe, a, v
            adam(soft, h.T @ p, s1, s2)
            adam(bias, p.sum(0), b1, b2)
    return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1200, max_clean: int = 2400, max_chars: int = 1 << 16) -> tuple[np.ndarray, float] | None:
    """The model from labelled rows that aren't held out, or None if a class is missing."""
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda k, n: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = first(1, max_toxic).unionByName(first(0, max_clean))  # at most max_toxic + max_clean ids
    short = F.coalesce(F.length("text"), F.lit(0)) <= max_chars
    rows = docs.select("doc_id", "text").where(short).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    found = rows.groupBy().applyInPandas(_fitted, "logits binary, bias double").collect()  # one row, of 2**BITS floats
    return (np.frombuffer(found[0]["logits"], np.float32), found[0]["bias"]) if found else None


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """The model of a bounded sample, fitted in one task so that the driver need not hold texts; no row if a class is missing."""
    if rows["toxic"].nunique() < 2:
        return pd.DataFrame({"logits": [], "bias": []})
    rows = rows.sort_values("doc_id")
    texts, labels = rows["text"].tolist(), rows["toxic"].to_numpy()
    del rows
    logits, bias = fit(texts, labels)
    del texts
    freed()
    return pd.DataFrame({"logits": [logits.tobytes()], "bias": [bias]})


def score_of(text: Column, model: tuple[np.ndarray, float] | None) -> Column:
    """The probability that a text is toxic. Only the text goes to Python and only the score comes back."""
    if model is None:
        return F.lit(0.0)
    logits, bias = model

    def scores(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in frames:
            yield pd.Series(score_texts(x.tolist(), logits, bias))
            freed()

    scores.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")(text)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; empty and null texts get the bias's score, repeated rows equal ones, a null doc_id isn't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = docs.withColumn("score", score_of(F.col("text"), model))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
