"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment of words.

Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. An alignment of a test item
with a document scores MATCH, MISMATCH and GAP a word. The document leaks the item if an alignment comes
to THRESHOLD of a perfect copy's score, or to that of RUN words: a verbatim copy scores 1, one edited
in a fifth of its words about 0.7, one edited in a third 0.5.

Seeds are chosen so that no such alignment is missed. Let S be the score wanted and m the number of
matching words. There are at most 2m - S errors, so at least S / 2 - 1 of the m - 1 neighbouring matches have
one error at most between them: their words stand one or two words apart, in the item as in
the document. So every pair of words of an item that stand one or two apart is a candidate seed, by the place of its first
word; of the ceil(S / 2) - 1 places that must be hit, half may be left out, which are those whose
pairs most items share: the seeds are the rare ones, and the other half of the hits is still asked
for. A document has an item's alignment only where so many seeds lie within the words that
an alignment can span. Of those spots, an upper bound of the score leaves out what cannot come to S, as too few of its
words are the item's; the rest is aligned.

Items are looked at in blocks of at most BLOCK characters, one after the other, each against all
documents: neither the driver nor a task ever holds more than a block, however many items there are, and the work
grows with documents times blocks. Seeds that join a text to very many items are worked on in
parts of about PAIRS (seed, item) pairs.

Items of under MIN_WORDS words are matched exactly: a document that has all of one's words in a row leaks it, with
the score 1; of items under SHORT words, a document that has no other words.

Defined cases. Null or empty texts and items match nothing. Items of one
id are each looked at; the best counts, of equal ones the first end. Repeated rows of documents give
their pairs again. An empty table gives an empty result. Only doc_id and text, item_id and text are
read. Texts are looked at whole; a very long one needs about 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import freed, fresh, given_id, read, with_nulls, written
from sparkvane.llm.words import U, hashed_words, mixed, slices

MIN_WORDS, SHORT, THRESHOLD, RUN = 8, 4, 0.5, 50
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 8 << 20
#: Cells of alignment matrices' rows that are worked on together.
CELLS = 1 << 20
PAIRS = 1 << 20


def _pairs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words one or two apart in texts: the pair, the text and the place of its first word there."""
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - at[:-1][of]
    first = mixed(words + U(0x9E3779B97F4A7C15))
    out = []
    for d in (1, 2):
        some = np.flatnonzero(place < n[of] - d)
        out.append((mixed(first[some] + words[some + d]), of[some], place[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; of the last k - 1 places there is none."""
    h = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        h = mixed(h * U(0x9E3779B97F4A7C15) + words[j : j + len(h)] + U(j + 1))
    return h


def _distinct(g: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (pair, text), sorted."""
    order = np.lexsort((of, g))
    g, of = g[order], of[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (of[1:] != of[:-1]))) if len(g) else np.zeros(0, bool)
    return g[new], of[new]


@dataclass
class Items:
    """A block of test items: their words, and where each seed stands in them."""

    ids: np.ndarray | pd.api.extensions.ExtensionArray
    words: list[np.ndarray]
    least: np.ndarray  # of each item: the score that is a leak, in units
    hits: np.ndarray  # and how many seeds a leak has at least
    grams: np.ndarray  # distinct seeds, sorted
    entry: np.ndarray  # of each (item, seed): the seed's number, sorted by it
    item: np.ndarray
    maybe: np.ndarray | None = None
    has: np.ndarray | None = None  # by _spot: may the item hold the word
    #: By number of words under MIN_WORDS: the items' runs of words, hashed and sorted, and which items they are.
    short: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    @classmethod
    def of(cls, ids, texts, threshold: float = THRESHOLD) -> Items:
        words, at = hashed_words(list(texts), marks=True)
        all_words, size = words, np.diff(at)
        each = [words[at[i] : at[i + 1]] if size[i] >= MIN_WORDS else words[:0] for i in range(len(at) - 1)]
        n = np.array([len(w) for w in each], np.int64)
        least = np.ceil(np.minimum(MATCH * n * threshold, MATCH * RUN) - 1e-9).astype(np.int64)
        must = np.maximum(-(-least // 2) - 1, 1)
        g, of, place = _pairs(np.concatenate(each) if each else words[:0], np.concatenate(([0], np.cumsum(n))))
        # how many items share the commonest pair of a place
        kinds, items = np.unique(_distinct(g, of)[0], return_counts=True)
        shared = items[np.searchsorted(kinds, g)] if len(g) else np.zeros(0, np.int64)
        spot = np.concatenate(([0], np.cumsum(n)))[:-1][of] + place
        common = np.zeros(n.sum(), np.int64)
        np.maximum.at(common, spot, shared)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((np.arange(len(owner)), -common, owner))
        nth = np.empty(len(owner), np.int64)
        nth[order] = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(n)))[:-1][owner[order]]
        rare = nth[spot] >= must[of] // 2
        g, of = _distinct(g[rare], of[rare])
        grams, entry = np.unique(g, return_inverse=True)
        out = cls(ids if isinstance(ids, pd.api.extensions.ExtensionArray) else np.asarray(ids), each, least, must - must // 2, grams, entry, of)
        out.short = {}
        for k in range(1, MIN_WORDS):
            if len(some := np.flatnonzero(size == k)):
                h = _runs(all_words, k)[at[some]]
                out.short[k] = (np.sort(h), some[np.argsort(h, kind="stable")])
        out.maybe = np.zeros(1 << max(20, int(16 * len(grams)).bit_length()), bool)
        out.maybe[out._slot(grams)] = True
        out.has = np.zeros(1 << max(16, int(16 * n.sum()).bit_length()), bool)
        if n.sum():
            out.has[out._spot(owner, np.concatenate(each))] = True
        return out

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> U(65 - len(self.maybe).bit_length())).astype(np.int64)

    def _spot(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (mixed(words + item.astype(U) * U(0x9E3779B97F4A7C15)) >> U(65 - len(self.has).bit_length())).astype(np.int64)

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs given are seeds of the block, and their numbers."""
        some = np.flatnonzero(self.maybe[self._slot(grams)])
        if not len(self.grams):
            return some[:0], some[:0]
        number = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
        same = self.grams[number] == grams[some]
        return some[same], number[same]


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignments of word sequences in pairs: the score, and where in the text it ends."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = np.lexsort(([len(t) for t in texts], [len(i) for i in items]))
    s = 0
    while s < len(order):
        e, wide, high = s, 0, 0
        while e < len(order):
            w, h = max(wide, len(texts[order[e]])), max(high, len(items[order[e]]))
            if e > s and w * (e - s + 1) > CELLS:
                break
            wide, high, e = w, h, e + 1
        rows = order[s:e]
        a, b = np.zeros((e - s, high), U), np.ones((e - s, wide), U)  # 0 and 1 stand for no word
        for k, r in enumerate(rows):
            a[k, : len(items[r])], b[k, : len(texts[r])] = items[r], texts[r]
        h = np.zeros((e - s, wide + 1), np.int32)
        ramp = -GAP * np.arange(wide + 1, dtype=np.int32)
        for i in range(high):
            t = np.zeros_like(h)
            t[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH), h[:, 1:] + GAP))
            h = np.maximum.accumulate(t + ramp, axis=1) - ramp  # gaps along the text
            m = h.max(1)
            better = m > best[rows]
            if better.any():
                end[rows[better]] = h[better].argmax(1)
                best[rows[better]] = m[better]
        s = e
    return best, end


def bound(items: Items, item: np.ndarray, words: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """No alignment of the item with words[begin:stop] scores more: the best run, a word that the item may hold MATCH, others the lesser loss."""
    out = np.zeros(len(item), np.int64)
    order = np.argsort(stop - begin, kind="stable")
    s = 0
    while s < len(order):
        e = s + 1
        while e < len(order) and (stop[order[e]] - begin[order[e]]) * (e - s + 1) <= CELLS:
            e += 1
        rows = order[s:e]
        n = stop[rows] - begin[rows]
        across = np.arange(n.max(initial=0))
        inside = across < n[:, None]
        text = words[np.where(inside, begin[rows, None] + across, 0)]
        gain = np.where(inside, np.where(items.has[items._spot(item[rows, None], text)], MATCH, max(MISMATCH, GAP)), 0)
        total = np.zeros((len(rows), len(across) + 1), np.int32)
        np.cumsum(gain, axis=1, out=total[:, 1:])
        out[rows] = (total - np.minimum.accumulate(total, axis=1)).max(1)
        s = e
    return out


def _joined(items: Items, doc: np.ndarray, start: np.ndarray, number: np.ndarray) -> Iterator[tuple]:
    """doc, start, item of seeds (sorted by doc) and their items, in parts that keep a text's seeds of an item together."""
    n_items = len(items.words)
    key = items.entry * n_items + items.item
    todo = [(0, len(doc), 0, n_items)] if len(doc) else []
    while todo:
        a, b, i, j = todo.pop()
        lo, hi = np.searchsorted(key, number[a:b] * n_items + i), np.searchsorted(key, number[a:b] * n_items + j)
        n = hi - lo
        if n.sum() > PAIRS and (doc[a] < doc[b - 1] or j - i > 1):
            if doc[a] < doc[b - 1]:
                m = np.searchsorted(doc, doc[(a + b) // 2])
                m = m if m > a else np.searchsorted(doc, doc[a], "right")
                todo += [(a, m, i, j), (m, b, i, j)]
            else:
                todo += [(a, b, i, (i + j) // 2), (a, b, (i + j) // 2, j)]
        elif n.sum():
            e = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield np.repeat(doc[a:b], n), np.repeat(start[a:b], n), items.item[e]


def _spots(items: Items, d: np.ndarray, t: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, item, first and last word, seeds of all stretches that can hold a leak."""
    n_items = len(items.words)
    key = np.sort(((d * n_items + i).astype(U) << U(32)) | t.astype(U))  # texts and items are under 2**32 pairs
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]  # a place of the text counts once
    t, both = (key & U((1 << 32) - 1)).astype(np.int64), (key >> U(32)).astype(np.int64)
    d, i = both // n_items, both % n_items
    size = np.array([len(w) for w in items.words], np.int64)
    reach = (3 * size - items.least)[i]  # an alignment spans so many words of a text at most
    far = np.arange(len(t)) + items.hits[i] - 1
    ok = far < len(t)
    far = np.where(ok, far, 0)
    ok &= (both[far] == both) & (t[far] - t <= reach)
    d, i, begin, stop = d[ok], i[ok], (t - reach)[ok], (t + reach + 1)[ok]
    if not len(d):
        return d, i, begin, stop, begin
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (begin[1:] > stop[:-1]))))
    return d[first], i[first], begin[first], np.maximum.reduceat(stop, first), np.diff(np.append(first, len(d)))


def _verbatim(words: np.ndarray, at: np.ndarray, items: Items) -> Iterator[pd.DataFrame]:
    """The short items of texts: row, item, score, end_word, seeds."""
    size = np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words)) - at[:-1][of]
    for k, (hashes, numbers) in (items.short or {}).items():
        h = _runs(words, k)
        n, p = size[of[: len(h)]], place[: len(h)]
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        spot = np.flatnonzero((lo < hi) & ((p <= n - k) if k >= SHORT else (n == k) & (p == 0)))
        many = (hi - lo)[spot]
        which = np.repeat(lo[spot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(spot) else spot
        spot = np.repeat(spot, many)
        yield pd.DataFrame({"row": of[spot], "item": numbers[which], "score": 1.0, "end_word": place[spot] + k, "seeds": k - 1})


_NO_LEAKS = {"row": np.int64, "item": np.int64, "score": np.float64, "end_word": np.int64, "seeds": np.int64}


def leaks(texts: list[str | None], items: Items) -> pd.DataFrame:
    """row, item (its number), score, end_word, seeds: the best alignment of each text with each item that it leaks."""
    out = []
    size = np.array([len(w) for w in items.words], np.int64)
    for a, b in slices(texts):
        words, at = hashed_words(texts[a:b], marks=True)
        out += [x.assign(row=x["row"] + a) for x in _verbatim(words, at, items)]
        pairs, of, place = _pairs(words, at)
        where, number = items.found(pairs)
        where, number = (x[np.argsort(of[where], kind="stable")] for x in (where, number))
        for d, t, i in _joined(items, of[where], place[where], number):
            d, i, begin, stop, seeds = _spots(items, d, t, i)
            begin = np.maximum(begin, 0)
            p, q = at[d] + begin, np.minimum(at[d] + stop, at[d + 1])
            some = bound(items, i, words, p, q) >= items.least[i]
            d, i, begin, seeds, p, q = d[some], i[some], begin[some], seeds[some], p[some], q[some]
            score, end = align([items.words[k] for k in i], [words[x:y] for x, y in zip(p, q, strict=True)])
            some = score >= items.least[i]
            out.append(pd.DataFrame({"row": d + a, "item": i, "score": score / (MATCH * np.maximum(size[i], 1)), "end_word": begin + end, "seeds": seeds})[some])
    if not out:
        return pd.DataFrame({k: np.zeros(0, v) for k, v in _NO_LEAKS.items()})
    found = pd.concat(out).sort_values(["row", "item", "score", "end_word"], ascending=[True, True, False, True])
    return found.drop_duplicates(["row", "item"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where(F.col("text").isNotNull())


def n_blocks(benchmark: DataFrame, size: int = BLOCK) -> int:
    total = _items(benchmark).agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    return int(total // size) + 1


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK) -> Iterator[Items]:
    """The test items in blocks of about `size` characters, each made when it is asked for."""
    n = n_blocks(benchmark, size)
    for k in range(n):
        some = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        some = some.select(*given_id("item_id"), "text").toPandas()  # a block
        block = Items.of(with_nulls(some["item_id"], some["no_item_id"]), some["text"].tolist(), threshold)
        if len(block.grams) or block.short:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, end_word, seeds of every document that leaks an item."""
    schema, out, several = "doc_id long, item_id long, score double, end_word long, seeds long", None, n_blocks(benchmark, size) > 1
    for block in blocks(benchmark, threshold, size):

        def batches(frames: Iterator[pd.DataFrame], block: Items = block) -> Iterator[pd.DataFrame]:
            for x in frames:
                found = leaks(x["text"].tolist(), block)
                ids = with_nulls(x["doc_id"], x["no_doc_id"])
                yield pd.DataFrame({"doc_id": ids[found["row"].to_numpy()], "item_id": block.ids[found["item"].to_numpy()], "score": found["score"].to_numpy(), "end_word": found["end_word"].to_numpy(), "seeds": found["seeds"].to_numpy()})

        found = docs.select(*given_id("doc_id"), "text").mapInPandas(batches, schema)
        found = written(found) if several else found  # a block isn't held once it is done
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def leaked(text: Column, block: Items) -> Column:
    """Whether a text leaks an item of the block. Only that comes back from Python."""

    def any_item(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in frames:
            out = np.zeros(len(x), bool)
            out[leaks(x.tolist(), block)["row"].to_numpy(np.int64)] = True
            yield pd.Series(out)
            freed()

    any_item.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(any_item, "boolean")(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK) -> DataFrame:
    """docs without the rows whose text leaks an item. With several blocks, texts that leak are noted by MD5, a written table for each block."""
    if n_blocks(benchmark, size) == 1:
        for block in blocks(benchmark, threshold, size):
            return docs.where(~leaked(F.col("text"), block))
        return docs
    gone, name = None, fresh(docs, "leak")
    for block in blocks(benchmark, threshold, size):
        some = written(docs.where(leaked(F.col("text"), block)).select(F.md5("text").alias(name)).distinct())
        gone = some if gone is None else gone.unionByName(some)
    return docs if gone is None else docs.join(gone, F.md5(docs["text"]) == gone[name], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, end_word, seeds of every document that leaks a test item, and of repeated rows each.

    Null and empty texts or items match nothing, items under eight words only verbatim; empty tables give no rows; other columns aren't read.
    """
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
