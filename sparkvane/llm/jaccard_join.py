"""N-gram Jaccard self-join: a universe-partition pigeonhole over size bands, verified exactly.

A document's set is its distinct shingles. Bands of sizes are such that a pair that links is within
a band or two adjacent ones. In a band no linking pair differs in over H shingles; a hash deals the
universe out to more segments than differences can reach:

- H + 1 segments: one at least is equal in both sets; each set indexes its segments; or
- H // 2 + 1 segments: one at least differs by one shingle at most; each set indexes its segments and
  their one-deletion neighbourhoods.

The cheaper of both is taken for each band (allocation), by the rows that it makes and the chance that
a segment lies wholly in a passage that many documents share. Some spare segments let every
set leave out its most common segments, those with the fewest shingles that few documents hold (counted
over all documents, in a sketch of fixed size). Sets that agree in a key are candidates. The
candidates' components are a coarsening of the result: no link crosses them. So each set is then
sent once, to its coarse component, where links are checked exactly, breadth first, against those
not yet reached. A coarse component of over WHOLE shingles is cut into blocks. Its first block is checked with
each of them, which joins most of a group of near copies; then only what is outside the component's
largest class so far is checked with every block, as no other pair of documents of different classes is left.

Defined cases. A set of fewer words than a shingle's is the sequence of all words; a null, empty or
blank text has no set and links with nothing. Rows of one doc_id are one document. A row without doc_id
is a document of its own, but for rows of the same text: it links like any other, but never names a component, and one of
only such documents has the component null. Equal sets link. Ties
don't occur: links follow from whole numbers alone. An empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import SMALL, freed, met, read, written
from sparkvane.llm.components import components
from sparkvane.llm.words import MOST_TEXTS, U, distinct, hashed_words, mixed, shingles, slices

#: Counters, in a sketch of fixed size, of the documents that hold a shingle, and counters to a row of it.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Shingles in a coarse component, or a block of one, that are checked in one task.
WHOLE = 1 << 17
#: Keys are dealt out to so many parts, each packed into one row of a batch of over HELD keys; bits of a key, beside the number of a document in its batch.
PART_BITS, HELD, NUMBER_BITS = 12, 4_000_000, 16
PARTS = 1 << PART_BITS
#: Sets, and shingles at a time, of a product of matrices at most.
DENSE_SETS = 2048


@dataclass(frozen=True)
class Rule:
    """Sets of `words`-word shingles link when den * intersection >= num * union."""

    words: int = 4
    num: int = 85
    den: int = 100
    #: A passage of so many shingles may be common to many documents.
    shared: int = 64
    #: Cost of a chance candidate against that of an indexed row.
    dear: float = 2000.0

    def links(self, a: int, b: int, both):
        return self.den * both >= self.num * (a + b - both)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    #: Differences of a linking pair whose smaller set is in this band.
    most: int
    deletions: bool
    segments: int
    spare: int


def bands(rule: Rule, largest: int) -> list[Band]:
    out, low = [], 1
    while low <= max(1, largest):
        high = low * rule.den // rule.num
        most = high * (rule.den - rule.num) // rule.num
        q = min(0.8, rule.shared / high)

        def cost(n: int, deletions: bool, high: int = high, q: float = q) -> float:
            size = high / n
            return n * ((size + 1) + rule.dear * q ** max(0.0, size - 1) if deletions else 1 + rule.dear * q**size)

        exact, near = most + 1, most // 2 + 1
        deletions = cost(near, True) < cost(exact, False)
        n = near if deletions else exact
        spare = 0 if most == 0 else -(-n * (10 if deletions else 18) // 100)
        out.append(Band(len(out), low, high, most, deletions, n + spare, spare))
        low = high + 1
    return out


def keys_of(tokens: np.ndarray, of: np.ndarray, sizes: np.ndarray, band: np.ndarray, table: list[Band], common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys that sets index in the bands given (one for each set, or -1), and each key's set.

    common tells for each counter of the sketch if its shingles are in many documents. It decides what is
    left out, alike for equal segments, and never whether a link is found.
    """
    n = len(sizes)
    use = (band >= 0) & (sizes > 0)
    use &= np.array([table[b].most > 0 if b >= 0 else False for b in band], bool) if n else use
    if not use.any():
        return np.zeros(0, U), np.zeros(0, np.int64)
    segs = np.where(use, np.array([table[b].segments for b in band]), 0)
    spare = np.array([table[b].spare for b in band])
    dele = np.array([table[b].deletions for b in band])
    first = np.concatenate(([0], np.cumsum(segs)))
    keep = use[of]
    t, o = tokens[keep], of[keep]
    salt = mixed(band.astype(U) + U(77))[o]
    seg = ((mixed(t ^ salt) >> U(32)) * segs[o].astype(U)) >> U(32)
    slot = first[o] + seg.astype(np.int64)
    value = mixed(t + U(12345))
    sums = np.zeros(first[-1], U)
    np.add.at(sums, slot, value)
    rare = np.ones(len(t), bool) if common is None else ~common[_counter(t)]
    count = np.bincount(slot[rare], minlength=first[-1])
    owner = np.repeat(np.arange(n), segs)
    # the largest number of rare shingles below which a set leaves out no more segments than it can spare
    cut = np.zeros(n, np.int64)
    going = use.copy()
    c = 1
    while going.any():
        few = np.bincount(owner, count < c, n)
        going &= few <= spare
        cut[going] = c
        c += 1
        if c > count.max() + 1:
            break
    emit = count >= cut[owner] - dele[owner]
    place = (np.arange(first[-1]) - first[owner]).astype(U)
    name = mixed(place * U(0x9E3779B97F4A7C15) + (band[owner].astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F))
    keys, sets = [mixed(sums[emit] + name[emit])], [owner[emit]]
    less = emit[slot] & dele[o]
    if less.any():
        keys.append(mixed(sums[slot[less]] - value[less] + name[slot[less]]))
        sets.append(o[less])
    return np.concatenate(keys), np.concatenate(sets)


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens) & U(COUNTERS - 1)).astype(np.int64)


def prefix_keys(rule: Rule, tokens: np.ndarray, of: np.ndarray, sizes: np.ndarray, table: list[Band], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rarest shingles of each set, in its bands, and each key's set; sets that link have such a shingle in common.

    A set links only with sets that hold num / den of it, so that of its shingles, in one order for all sets, the
    first of as many as may be missing and one more will do. counts, a sketch of how many sets hold a shingle, gives the order.
    """
    order = np.lexsort((tokens, counts[_counter(tokens)], of))  # of is in order already
    first = np.cumsum(sizes) - sizes
    few = sizes + rule.num * sizes // -rule.den + 1
    some = np.arange(len(order)) - first[of] < few[of]
    t, o = tokens[order[some]], of[some]
    own = np.searchsorted([b.high for b in table], sizes)
    return np.concatenate([mixed(t ^ mixed((band + 2).astype(U) * U(0x9E3779B97F4A7C15))[o]) for band in (own, own - 1)]), np.concatenate([o, o])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a, b join, at most one for a node: each node to the least that it reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(node))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    some = up != np.arange(len(node))
    return node[some], node[up[some]]


def _sets(texts: list, words: int):
    w, at = hashed_words(texts)
    tokens, of, _ = distinct(*shingles(w, at, words))
    return tokens, of, np.bincount(of, minlength=len(texts)).astype(np.int64)


def _measure(rule: Rule):
    """Every row's set: its size and a digest of 128 bits."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for x in frames:
            freed()
            texts = x["text"].tolist()
            parts = []
            for s, e in slices(texts):
                tokens, of, n = _sets(texts[s:e], rule.words)
                counts += np.bincount(_counter(tokens), minlength=COUNTERS)
                d1, d2 = np.zeros(len(n), U), np.zeros(len(n), U)
                np.add.at(d1, of, mixed(tokens))
                np.add.at(d2, of, mixed(tokens ^ U(0x5851F42D4C957F2D)))
                parts.append((n, d1.view(np.int64), d2.view(np.int64)))
            n, d1, d2 = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
            yield pd.DataFrame({"doc_id": x["doc_id"], "text_hash": x["text_hash"], "n": n, "d1": d1, "d2": d2, "counts": None})
        if counts.any():
            yield _chunks(counts)

    return batches


def _chunks(counts: np.ndarray) -> pd.DataFrame:
    """Counters as rows of _MEASURED: n is the number of the chunk."""
    rows = [(0, 0, i, 0, 0, counts[i * CHUNK : (i + 1) * CHUNK].tobytes()) for i in range(COUNTERS // CHUNK)]
    return pd.DataFrame(rows, columns=["doc_id", "text_hash", "n", "d1", "d2", "counts"])


_MEASURED = "doc_id long, text_hash long, n long, d1 long, d2 long, counts binary"


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sketch of all in a partition."""
    total = np.zeros(COUNTERS, np.int64)
    for x in frames:
        for i, c in zip(x["n"], x["counts"], strict=True):
            total[i * CHUNK : (i + 1) * CHUNK] += np.frombuffer(c, np.int64)
    if total.any():
        yield _chunks(total)


def common_counters(measured: DataFrame) -> np.ndarray:
    """Which counters are far above the others."""
    total = counters(measured)
    usual = float(np.median(total))
    return total > usual + 6 * usual**0.5 + 16


def counters(measured: DataFrame) -> np.ndarray:
    """The sketch of all: COUNTERS numbers come to the driver, whatever the input."""
    parts = measured.where("counts is not null").mapInPandas(_added, _MEASURED)
    chunk = lambda x: pd.DataFrame({"n": [int(x["n"].iloc[0])], "counts": [np.sum([np.frombuffer(c, np.int64) for c in x["counts"]], axis=0).tobytes()]})
    total = np.zeros(COUNTERS, np.int64)
    for row in parts.groupBy("n").applyInPandas(chunk, "n long, counts binary").collect():
        total[row["n"] * CHUNK : (row["n"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int64)
    return total


_PACKED = "part int, edges boolean, a binary, b binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes as all their first bytes, all their second ones, ...: bytes that are alike stand together and are packed well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(keys: np.ndarray, sets: np.ndarray, docs: np.ndarray) -> Iterator[pd.DataFrame]:
    """Keys, cut to KEY_BITS, with a document of each, a row for each part of the keys; and the edges among documents that meet in a key here.

    sets: the number of each key's document in docs, of which there are 1 << NUMBER_BITS at most.
    """
    low = U((1 << NUMBER_BITS) - 1)
    both = np.sort((keys & ~low) | sets.astype(U))
    key, number = both & ~low, (both & low).astype(np.int64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    key, head = key[new], number[new]
    other = ~new
    yield _edges(docs[number[other]], docs[head[(np.cumsum(new) - 1)[other]]])
    cut = np.searchsorted(key, np.arange(1, PARTS).astype(U) << U(64 - PART_BITS))
    parts = [(i, False, _planes(k), _planes(docs[h])) for i, (k, h) in enumerate(zip(np.split(key, cut), np.split(head, cut), strict=True)) if len(k)]
    for i in range(0, len(parts), 512):
        yield pd.DataFrame(parts[i : i + 512], columns=["part", "edges", "a", "b"])


def _edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    a, b = _forest(a, b)
    return pd.DataFrame({"part": [int(a[0]) % PARTS], "edges": [True], "a": [_planes(a)], "b": [_planes(b)]} if len(a) else {"part": [], "edges": [], "a": [], "b": []}).astype({"part": np.int32, "edges": bool})


def _index(rule: Rule, keys_of_sets):
    """The keys of every row's set, packed. keys_of_sets: of tokens, their sets, sizes and bands, the keys and each one's set."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = bands(rule, 1 << 20)
        keys, sets, docs, held, many = [], [], [], 0, 0
        for x in frames:
            freed()
            texts, ids = x["text"].tolist(), x["doc_id"].to_numpy(np.int64)
            for s, e in slices(texts):
                tokens, of, n = _sets(texts[s:e], rule.words)
                if len(n) and n.max() > table[-1].high:
                    table = bands(rule, int(n.max()))
                k, o = keys_of_sets(tokens, of, n, table)
                keys.append(k)
                sets.append(o + many)
                docs.append(ids[s:e])
                held, many = held + len(k), many + e - s
                if held > HELD or many + MOST_TEXTS > 1 << NUMBER_BITS:
                    yield from _packed(np.concatenate(keys), np.concatenate(sets), np.concatenate(docs))
                    keys, sets, docs, held, many = [], [], [], 0, 0
        if held:
            yield from _packed(np.concatenate(keys), np.concatenate(sets), np.concatenate(docs))
            keys, sets, docs = [], [], []
        freed()

    return batches


def _segments(rule: Rule, common: np.ndarray):
    def keys(tokens, of, n, table):
        own = np.searchsorted([b.high for b in table], n)
        found = [keys_of(tokens, of, n, np.where(n > 0, band, -1), table, common) for band in (own, own - 1)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return _index(rule, keys)


def _prefixes(rule: Rule, counts: np.ndarray):
    return _index(rule, lambda tokens, of, n, table: prefix_keys(rule, tokens, of, n, table, counts))


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges that join the documents that meet in keys of this partition, and those known already."""
    keys, ids, a, b = [np.zeros(0, U)], [np.zeros(0, np.int64)], [], []
    for x in frames:
        for edges, p, q in zip(x["edges"], x["a"], x["b"], strict=True):
            (a if edges else keys).append(_numbers(p, np.int64 if edges else U))
            (b if edges else ids).append(_numbers(q, np.int64))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    # most keys have one document: those of which there are others are found first, but for some too many
    place = lambda k: ((k >> U(NUMBER_BITS)) & U((1 << 22) - 1)).astype(np.int64)
    ordered, twice = np.sort(keys), np.zeros(1 << 22, bool)
    twice[place(ordered[1:][ordered[1:] == ordered[:-1]])] = True
    some = twice[place(keys)]
    keys, ids = keys[some], ids[some]
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    head = np.repeat(ids[new], np.diff(np.append(new, len(keys))))
    out, to = _forest(np.concatenate([ids, *a]), np.concatenate([head, *b]))
    yield pd.DataFrame({"a": out, "b": to})
    del keys, ids, ordered, twice, some, order, new, head, a, b, out, to
    freed()


def _coarse(packed: DataFrame) -> DataFrame:
    """Components of the documents that meet in a key."""
    return components(packed.repartition("part").mapInPandas(_met, "a long, b long"))


def _all_links(sets: list[np.ndarray], size: np.ndarray, rule: Rule) -> list[tuple[int, int]] | None:
    """Links that connect what is connected, of all intersections at once as a product of matrices; None where most shingles are in few sets, so that it doesn't pay."""
    g = len(sets)
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    if g > DENSE_SETS or size.max() >= 1 << 24 or (n * n).sum() * 100 < float(g) * g * np.count_nonzero(n > 1):
        return None
    owner, column, both = np.repeat(np.arange(g), size), np.cumsum(n > 1) - 1, np.zeros((g, g), np.float32)
    token, owner = column[token[n[token] > 1]], owner[n[token] > 1]
    for a in range(0, int(column[-1]) + 1, DENSE_SETS):
        some = (token >= a) & (token < a + DENSE_SETS)
        held = np.zeros((g, min(DENSE_SETS, int(column[-1]) + 1 - a)), np.float32)
        held[owner[some], token[some] - a] = 1
        both += held @ held.T  # whole numbers below 2^24 are exact
    x, y = np.nonzero(np.triu(rule.links(size[:, None], size[None, :], both.astype(np.int64)), 1))
    return list(zip(*(i.tolist() for i in _forest(x, y)), strict=True))


def spanning_links(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what is connected: of sets with much in common at once, else breadth first, each set against those not yet reached."""
    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    out: list[tuple[int, int]] = []
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if rule.links(int(size[0]), int(size[1]), both) else []
    if g >= 16 and (found := _all_links(sets, size, rule)) is not None:
        return found
    waiting = np.ones(g, bool)
    token = owner = None
    indexed = 0
    queue: list[int] = []
    while waiting.any():
        if not queue:
            x = int(np.flatnonzero(waiting)[0])
            waiting[x] = False
            queue.append(x)
        left = int(waiting.sum())
        if not left:
            break
        if token is None or left * 2 < indexed:
            some = np.flatnonzero(waiting)
            token = np.concatenate([sets[i] for i in some])
            owner = np.repeat(some, size[some])
            order = np.argsort(token, kind="stable")
            token, owner, indexed = token[order], owner[order], left
        x = queue.pop()
        lo, hi = np.searchsorted(token, sets[x], "left"), np.searchsorted(token, sets[x], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=g)
        found = np.flatnonzero(waiting & rule.links(size[x], size, both))
        waiting[found] = False
        out += [(x, int(y)) for y in found]
        queue += found.tolist()
    return out


def _check(rule: Rule):
    def group(x: pd.DataFrame) -> pd.DataFrame:
        if x["text"].str.len().sum() > 8 * WHOLE * rule.words:
            freed()
        a, b = [], []
        x = x.sort_values(["coarse", "doc_id"])
        docs, coarse, texts = x["doc_id"].to_numpy(np.int64), x["coarse"].to_numpy(), x["text"].tolist()
        ends = np.flatnonzero(np.concatenate(([True], coarse[1:] != coarse[:-1], [True])))
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            sets = []
            for p, q in slices(texts[s:e]):
                tokens, _, n = _sets(texts[s + p : s + q], rule.words)
                sets += np.split(tokens, np.cumsum(n)[:-1])
            if e - s > 1:
                for i, j in spanning_links(sets, rule):
                    a.append(docs[s + i])
                    b.append(docs[s + j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return group


def _outside(first: DataFrame, fine: DataFrame) -> DataFrame:
    """Members of components in blocks, with `own`, the group of a member that is outside its component's largest class, and `groups`, how many there are; components without such members are left out."""
    label = first.join(fine, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    sizes = label.groupBy("coarse", "label").agg(F.sum("n").alias("size"))
    largest = sizes.groupBy("coarse").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most"))
    groups = F.ceil((F.col("all") - F.col("most")) / WHOLE).cast("int")
    held = label.join(largest.where("all > most").withColumn("groups", groups), "coarse")
    own = F.when(F.col("label") != F.col("largest"), F.pmod(F.xxhash64("doc_id", F.lit("own")), F.col("groups")).cast("int"))
    return held.select("doc_id", "text_hash", "coarse", "blocks", "block", "groups", own.alias("own"))


def _narrowed(rows: DataFrame, member: DataFrame, rule: Rule) -> DataFrame:
    """member (doc_id, text_hash, n, coarse), where coarse components of over WHOLE shingles, which passages in common may have chained, are parted into those by prefix_keys."""
    large = written(member.groupBy("coarse").agg(F.sum("n").alias("all")).where(F.col("all") > WHOLE))
    if large.isEmpty():
        return member
    inside = written(met(member, large.select("coarse"), ["coarse"], F.col("doc_id"), "inner"))
    n = inside.agg(F.count("*").alias("rows"), F.sum("n").alias("all")).first()
    held = inside.select("doc_id", "text_hash")
    texts = rows.join(F.broadcast(held) if n["rows"] <= SMALL else held, ["doc_id", "text_hash"])
    # few tasks, as each has a sketch
    texts = written(texts.repartition(max(member.sparkSession.sparkContext.defaultParallelism, n["all"] >> 22)))
    counts = np.minimum(counters(texts.mapInPandas(_measure(rule), _MEASURED)), (1 << 16) - 1).astype(np.uint16)
    coarse = _coarse(texts.mapInPandas(_prefixes(rule, counts), _PACKED))
    within = inside.join(coarse, F.col("doc_id") == F.col("node")).select("doc_id", "text_hash", "n", F.col("component").alias("coarse"))
    other = member.join(large.select("coarse"), "coarse", "left_anti").select("doc_id", "text_hash", "n", "coarse")
    return written(other.unionByName(within))


def _node(text_hash: Column) -> Column:
    """The node of a document without id: of 62 bits, below the ids that are in use."""
    return F.shiftrightunsigned(text_hash, 2) + F.lit(-(1 << 63))


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Null ids come back as null."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), _node(F.xxhash64("text"))).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    measured = written(rows.mapInPandas(_measure(rule), _MEASURED))
    common = common_counters(measured)
    sets = measured.where("counts is null").drop("counts")

    # copies meet by their digest; one document of each set is looked at further
    least = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    least = written(least.where("least <> greatest").drop("greatest"))
    firsts = met(sets.where("n > 0"), least, ["n", "d1", "d2"], F.struct("doc_id", "text_hash"), "inner", SMALL)
    copies = written(firsts.where("doc_id <> least").select("doc_id", "text_hash", "least").distinct())
    n_copies = copies.count()
    rest = copies.select("doc_id", "text_hash")
    rows = rows.join(F.broadcast(rest) if n_copies <= SMALL else rest, ["doc_id", "text_hash"], "left_anti")
    coarse = _coarse(rows.mapInPandas(_segments(rule, common), _PACKED))

    # sets whose coarse component has others
    member = sets.where("n > 0").join(copies.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash", "n").distinct()
    member = written(member.join(coarse, F.col("doc_id") == F.col("node")).select("doc_id", "text_hash", "n", F.col("component").alias("coarse")))
    member = _narrowed(rows, member, rule)
    whole = member.groupBy("coarse").agg(F.sum("n").alias("all"))
    blocks = F.ceil(F.col("all") / WHOLE).cast("int")
    first = written(member.join(whole, "coarse").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).select("doc_id", "text_hash", "coarse", "n", "blocks", "block"))
    sent = F.when(F.col("block") == 0, F.col("blocks")).otherwise(1)
    n = first.agg(F.coalesce(F.sum(sent), F.lit(0)).alias("sent"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.max("blocks").alias("blocks")).first()
    bins = max(1, int(n["all"]) * 2 // WHOLE, spark.sparkContext.defaultParallelism)
    task = lambda b, i, j: F.struct(b.alias("bin"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    # of a coarse component in blocks, the first block and each other; of a small one, all in a bin of such
    row = lambda i: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: task(F.col("coarse"), i, j))
    alone = F.array(task(F.pmod(F.xxhash64("coarse"), F.lit(bins)), F.lit(-1), F.lit(-1)))
    large = F.when(F.col("block") == 0, row(F.lit(0))).otherwise(F.array(task(F.col("coarse"), F.lit(0), F.col("block"))))

    def checked(some: DataFrame, tasks: Column, few: bool) -> DataFrame:
        held = some.select("doc_id", "text_hash", "coarse", tasks.alias("tasks"))
        texts = rows.join(F.broadcast(held) if few else held, ["doc_id", "text_hash"])
        return texts.select(F.explode("tasks").alias("task"), "doc_id", "coarse", "text").groupBy("task").applyInPandas(_check(rule), "a long, b long")

    links = written(checked(first, F.when(F.col("blocks") > 1, large).otherwise(alone), n["sent"] <= SMALL))
    if (n["blocks"] or 1) > 1:
        fine = components(links)
        links = fine.select(F.col("node").alias("a"), F.col("component").alias("b"))  # the same classes, of fewer links
        more = written(_outside(first.where("blocks > 1"), fine))
        if not more.isEmpty():
            # what is outside stands in groups of its own, each of which meets every block
            groups = F.col("groups") - 1
            own = row(F.col("own"))
            every = F.transform(F.sequence(F.lit(0), groups), lambda i: task(F.col("coarse"), i, F.col("block")))
            links = links.unionByName(checked(more, F.array_distinct(F.when(F.col("own").isNotNull(), F.concat(own, every)).otherwise(every)), False))

    fine = components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("least").alias("b"))))
    out = sets.join(fine, F.col("doc_id") == F.col("node"), "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    given = F.when(F.col("doc_id") != _node(F.col("text_hash")), F.col("doc_id"))
    if sets.where(given.isNull()).isEmpty():
        return out.drop("text_hash")
    # a component's name is the least of its ids, not of its nodes
    names = written(out.groupBy(F.col("component_id").alias("label")).agg(F.min(given).alias("name")))
    named = met(out.withColumnRenamed("component_id", "label"), names, ["label"], F.xxhash64("doc_id", "text_hash"))
    return named.select(given.alias("doc_id"), "n_shingles", F.col("name").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Texts without words have no shingles and are their own component; a null doc_id comes back as null and links by its
    text, without naming a component; repeated rows are one document; an empty table gives no rows.
    """
    return classes(read(spark, sf_dir, "documents"))
