"""Document fingerprints by SimHash, and search within a Hamming radius by permuted block tables.

The terms of a text are its shingles of TERM words, A to Z lower-cased, weighted by 1 + log2 of how
often they come. Each term's 128-bit hash votes on every bit, for or against by its weight; a
fingerprint has the signs. Two fingerprints' likeness is the cosine that their distance stands for,
max(0, cos(pi * distance / 128)).

The radius follows from the likeness wanted. Texts whose terms have a Jaccard similarity of 0.8 have
a cosine of 1.6 / 1.8 and differ in a bit with probability acos(1.6 / 1.8) / pi = 0.15: in 19.4 of
128 bits, with a deviation of 4.1. RADIUS leaves out about one in a hundred of them; unrelated texts
are about 64 bits apart.

Search goes by block tables, each of which has another block of bits in front, as its key. 128 bits are cut into BLOCKS blocks,
and the radius is shared out among them, so that fingerprints within it differ in one block at least by no more than
that block's share. Blocks of queries are sent to the tasks, which put them into a table for each block and look up, for every
fingerprint, all keys that differ in so many bits of the block. What is found is a candidate, whose distance is checked; so all fingerprints
within the radius are found. Work grows with documents times blocks of QUERIES queries. Up to a radius of TABLES there
is another way, by joins: 128 bits are cut into radius + 2 blocks, so that fingerprints within the radius agree on two of them, and for
each two blocks there is a table with them in front.

Defined cases. A null or empty text has no terms and the fingerprint 0; equal texts have equal
fingerprints. Documents are followed in descending doc_id, null last, then by text; repeated rows
follow each other. A single document is followed by itself. An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.llm.common import given_id, read, with_nulls, written
from sparkvane.llm.words import U, distinct, hashed_words, mixed, shingles, slices

BITS, TERM, RADIUS, TABLES, BLOCKS = 128, 3, 28, 6, 8
#: Candidates that a task checks at once, about, and fingerprints that it looks up at once.
CHECKED, LOOKED_UP = 1 << 20, 256
#: Queries that are sent to the tasks together.
QUERIES = 1 << 18
#: Bytes of text in a piece of the ordered corpus, and pieces at most, of which the driver holds a mark and a head each.
PIECE, PIECES = 16 << 20, 100_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def simhash(texts: list[str | None]) -> np.ndarray:
    """A fingerprint of 16 bytes for each text: an array of (len(texts), 2) 64-bit numbers."""
    out = np.zeros((len(texts), 2), U)
    for a, b in slices(texts):
        words, at = hashed_words(texts[a:b])
        terms, of, n = distinct(*shingles(words, at, TERM))
        if not len(terms):
            continue
        weight = np.round(4 * (1 + np.log2(n)))
        total = np.bincount(of, weight, b - a)
        hashes = np.stack([mixed(terms), mixed(terms ^ U(0x5851F42D4C957F2D))], 1).view(np.uint8)
        # the weight of every value of every byte, then of every bit
        votes = np.concatenate([np.bincount(of * 256 + hashes[:, i], weight, (b - a) * 256).reshape(-1, 256) @ _BYTE_BITS for i in range(BITS // 8)], axis=1)
        out[a:b] = np.packbits(2 * votes > total[:, None], axis=1).view(U)
    return out


def _above(x, marks: list[int]):
    """How many of the marks, sorted, are at or above x, all of them for null: in two steps of about the root of their number."""
    if not marks:
        return F.lit(0)
    marks = marks[::-1]
    step = int(len(marks) ** 0.5) + 1
    runs = [marks[i : i + step] for i in range(0, len(marks), step)]
    longs = lambda v: F.array(*[F.lit(int(m)).cast("long") for m in v])
    reached = lambda a: F.size(F.filter(a, lambda m: F.coalesce(m >= x, F.lit(True))))
    whole = reached(longs([r[-1] for r in runs]))  # runs that are at or above x as a whole
    return F.when(whole == len(runs), F.lit(len(marks))).otherwise(whole * step + reached(F.get(F.array(*map(longs, runs)), whole)))


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text that follows in descending doc_id, the first one's after the last.

    The order is cut into pieces at quantiles of doc_id; the first document of a piece also stands
    at the end of the piece before it. One shuffle of the texts, in pieces for all its parts, none of over about PIECE bytes
    (or a part in PIECES of all) but for a long text or a doc_id that many rows share.
    """
    rows = docs.select("doc_id", "text").withColumn("__h", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    # as many as a shuffle has parts at least, but for a text or two in each
    pieces = int(min(PIECES, max(size["b"] // PIECE + 1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["n"] // 50))))
    marks = []
    if pieces > 1:
        # one number for each piece comes to the driver
        found = rows.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], min(100 * pieces, 1_000_000))).first()[0]
        marks = sorted(set(found or []))
    piece = _above(F.col("doc_id"), marks)  # in the order: 0 has the largest ids; null ids come last
    spark = docs.sparkSession
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("__h").alias("c"))
    heads = rows.groupBy(piece.alias("piece")).agg(F.max(key).alias("k")).orderBy("piece").collect()  # one row a piece
    if not heads:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    before = [(heads[i]["piece"], heads[i - 1]["piece"], heads[i]["k"]["a"], heads[i]["k"]["b"], heads[i]["k"]["c"]) for i in range(len(heads))]
    ends = spark.createDataFrame(before, "p int, before int, a boolean, b long, c long")
    placed = rows.withColumn("piece", piece).withColumn("key", key).join(F.broadcast(ends), F.col("piece") == F.col("p"))  # a row for each piece
    is_head = (F.col("key.a") == F.col("a")) & (F.col("key.b") == F.col("b")) & (F.col("key.c") == F.col("c"))
    own = F.struct(F.col("piece").alias("at"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("before").alias("at"), F.lit(True).alias("extra"))
    placed = placed.withColumn("__p", F.explode(F.when(is_head, F.array(own, extra)).otherwise(F.array(own))))
    order = Window.partitionBy("__p.at").orderBy(F.col("__p.extra").asc(), F.col("key.a").desc(), F.col("key.b").desc(), F.col("__h").desc())
    return placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("__p.extra")).select("doc_id", "text", "next_text")


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprinted(pairs: DataFrame) -> DataFrame:
    """Of doc_id, text and next_text: the fingerprints of the text, the edited text and the next text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, next_hi long, next_lo long"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = [t or "" for t in x["text"]]
            following = [t or "" for t in x["next_text"]]
            new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            # a row's next text mostly is the next row's text
            later = [i + 1 if i + 1 < len(texts) and texts[i + 1] == f else -1 for i, f in enumerate(following)]
            own, alt = simhash(texts), simhash(new)
            rest = [i for i, j in enumerate(later) if j < 0]
            after = own[np.array(later, np.int64)] if len(texts) else own
            if rest:
                after[rest] = simhash([following[i] for i in rest])
            cols = {"doc_id": with_nulls(x["doc_id"], x["no_doc_id"]), "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]}
            for name, f in (("", own), ("edited_", alt), ("next_", after)):
                cols[f"{name}hi"], cols[f"{name}lo"] = f[:, 0].view(np.int64), f[:, 1].view(np.int64)
            yield pd.DataFrame(cols)

    return pairs.select(*given_id("doc_id"), "text", "next_text").mapInPandas(batches, schema)


def _distance(a: str, b: str, other: str = ""):
    """Bits in which the fingerprints with these column prefixes differ."""
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def _hex(prefix: str):
    return F.lower(F.concat(*[F.lpad(F.hex(f"{prefix}{half}"), 16, "0") for half in ("hi", "lo")]))


def likeness(distance):
    return F.greatest(F.lit(0.0), F.cos(distance * (np.pi / BITS)))


def _tables(fp: str, radius: int):
    """Keys of a 32-digit fingerprint, a struct of table and key for every two of radius + 2 blocks."""
    digits = BITS // 4
    cuts = [round(i * digits / (radius + 2)) for i in range(radius + 3)]
    part = lambda i: F.substring(fp, cuts[i] + 1, cuts[i + 1] - cuts[i])
    return F.array(*[F.struct(F.lit(n).alias("table"), F.concat(part(i), part(j)).alias("key")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))])


def within(queries: DataFrame, corpus: DataFrame, radius: int = TABLES) -> DataFrame:
    """Pairs query, found, distance of distinct fingerprints (columns fp, hi, lo of either) within the radius."""
    if radius > BITS // 4 - 2:
        raise ValueError("a block needs a digit at least")
    q = queries.select("fp", "hi", "lo").distinct().select(F.col("fp").alias("query"), F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.explode(_tables("fp", radius)).alias("t"))
    c = corpus.select("fp", "hi", "lo").distinct().select(F.col("fp").alias("found"), F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), F.explode(_tables("fp", radius)).alias("t"))
    pairs = q.select("query", "q_hi", "q_lo", "t.*").join(c.select("found", "c_hi", "c_lo", "t.*"), ["table", "key"])
    pairs = pairs.withColumn("distance", _distance("q_", "c_")).where(F.col("distance") <= radius)
    return pairs.select("query", "found", "distance").distinct()


def scanned(asked: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The same as looked_up, by comparing every row with every query: what tests hold it against."""
    queries = asked.select("hi", "lo").distinct()
    blocks = queries.count() // QUERIES + 1
    out = None
    for k in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("hi", "lo"), F.lit(blocks)) == k).toPandas()  # a block, about
        hi, lo = some["hi"].to_numpy(np.int64), some["lo"].to_numpy(np.int64)

        def batches(frames: Iterator[pd.DataFrame], hi: np.ndarray = hi, lo: np.ndarray = lo) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(hi), np.int64)
            for x in frames:
                u, v = x["hi"].to_numpy(np.int64).view(U)[:, None], x["lo"].to_numpy(np.int64).view(U)[:, None]
                for i in range(0, len(hi), 2048):
                    q, r = hi[i : i + 2048].view(U), lo[i : i + 2048].view(U)
                    for j in range(0, len(u), 64):
                        n[i : i + 2048] += np.count_nonzero(np.bitwise_count(u[j : j + 64] ^ q) + np.bitwise_count(v[j : j + 64] ^ r) <= radius, axis=0)
            some = np.flatnonzero(n)
            yield pd.DataFrame({"q_hi": hi[some], "q_lo": lo[some], "n": n[some]})

        one = rows.select("hi", "lo").mapInPandas(batches, "q_hi long, q_lo long, n long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("q_hi", "q_lo").agg(F.sum("n").alias("n"))


@dataclass
class BlockTables:
    """Queries by each of the blocks of their bits: all within the radius of a fingerprint are found by its keys and their neighbours."""

    hi: np.ndarray
    lo: np.ndarray
    radius: int
    cuts: list[int]
    masks: list[np.ndarray]  # of each block: the flips of as many bits as its share of the radius
    keys: list[np.ndarray]  # sorted
    query: list[np.ndarray]
    taken: list[np.ndarray]  # which keys there are

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray, radius: int) -> BlockTables:
        cuts = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
        out = cls(hi, lo, radius, cuts, [], [], [], [])
        for i, values in enumerate(out._values(hi, lo)):
            # radius + 1 units are dealt out; a block with s of them is searched up to s - 1 flips
            most, width = (radius + 1 + BLOCKS - 1 - i) // BLOCKS - 1, cuts[i + 1] - cuts[i]
            out.masks.append(np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.int64))
            order = np.argsort(values, kind="stable")
            out.keys.append(values[order])
            out.query.append(order)
            out.taken.append(np.zeros(1 << width, bool))
            out.taken[i][values] = True
        return out

    def _values(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(np.stack([hi, lo], 1).astype(">u8").view(np.uint8), axis=1)
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def near(self, hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fingerprint and query, by number, of all pairs within the radius, each once; in parts that keep a fingerprint's together."""
        found = []
        for i, values in enumerate(self._values(hi, lo)):
            row, flip = np.nonzero(self.taken[i][keys := values[:, None] ^ self.masks[i]])
            key = keys[row, flip]
            found.append((row, i, np.searchsorted(self.keys[i], key), np.searchsorted(self.keys[i], key, "right")))
        row = np.concatenate([f[0] for f in found])
        block = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        first, stop = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        order = np.argsort(row, kind="stable")
        row, block, first, n = row[order], block[order], first[order], (stop - first)[order]
        each = np.bincount(row, n, len(hi))
        for rows in np.split(np.arange(len(hi)), np.flatnonzero(np.diff(np.cumsum(each) // CHECKED)) + 1):
            a, b = np.searchsorted(row, [rows[0], rows[-1] + 1]) if len(rows) else (0, 0)
            if a == b:
                continue
            at = np.repeat(first[a:b] - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b]) + np.arange(n[a:b].sum())
            query, of = np.empty(len(at), np.int64), np.repeat(block[a:b], n[a:b])
            for i in range(BLOCKS):
                query[of == i] = self.query[i][at[of == i]]
            pair = np.unique(np.repeat(row[a:b], n[a:b]) * len(self.hi) + query)
            r, q = pair // len(self.hi), pair % len(self.hi)
            some = np.bitwise_count(hi[r] ^ self.hi[q]) + np.bitwise_count(lo[r] ^ self.lo[q]) <= self.radius
            yield r[some], q[some]


def looked_up(asked: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q_hi, q_lo, n: of each distinct fingerprint of asked, how many rows are within the radius (columns hi, lo of either). No pairs leave a task."""
    queries = asked.select("hi", "lo").distinct()
    blocks = queries.count() // QUERIES + 1
    out = None
    for k in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("hi", "lo"), F.lit(blocks)) == k).toPandas()  # a block, about
        hi, lo = some["hi"].to_numpy(np.int64).view(U), some["lo"].to_numpy(np.int64).view(U)

        def batches(frames: Iterator[pd.DataFrame], hi: np.ndarray = hi, lo: np.ndarray = lo) -> Iterator[pd.DataFrame]:
            tables, n = BlockTables.of(hi, lo, radius) if len(hi) else None, np.zeros(len(hi), np.int64)
            for x in frames if tables else ():
                own, copies = np.unique(x[["hi", "lo"]].to_numpy(np.int64), axis=0, return_counts=True)
                u, v = np.ascontiguousarray(own[:, 0]).view(U), np.ascontiguousarray(own[:, 1]).view(U)
                for i in range(0, len(u), LOOKED_UP):
                    for r, q in tables.near(u[i : i + LOOKED_UP], v[i : i + LOOKED_UP]):
                        np.add.at(n, q, copies[i + r])
            some = np.flatnonzero(n)
            yield pd.DataFrame({"q_hi": hi[some].view(np.int64), "q_lo": lo[some].view(np.int64), "n": n[some]})

        one = rows.select("hi", "lo").mapInPandas(batches, "q_hi long, q_lo long, n long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("q_hi", "q_lo").agg(F.sum("n").alias("n"))


def near_counts(asked: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q_hi, q_lo, n: of each distinct fingerprint of asked, how many rows are within the radius (columns fp, hi, lo of either)."""
    if radius > TABLES:
        return looked_up(asked, rows, radius)
    counts = rows.groupBy("fp", "hi", "lo").agg(F.count("*").alias("rows"))
    found = within(asked, counts, radius).join(counts.select(F.col("fp").alias("found"), "rows"), "found").groupBy("query").agg(F.sum("rows").alias("n"))
    return found.join(asked.select(F.col("fp").alias("query"), F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct(), "query").select("q_hi", "q_lo", "n")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprints and likenesses; near_docs, how many other documents are within the
    radius, for the query rows of the search, whose doc_id is divisible by 50 (else null). A null text is
    empty, a document alone is followed by itself, repeated rows get rows each, an empty table gives none."""
    rows = written(fingerprinted(followed(read(spark, sf_dir, "documents"))))
    rows = rows.withColumn("fp", _hex(""))
    near = near_counts(rows.where(F.col("doc_id") % 50 == 0), rows).withColumn("near_docs", F.col("n") - 1)
    out = rows.join(near, (rows["doc_id"] % 50 == 0) & (rows["hi"] == near["q_hi"]) & (rows["lo"] == near["q_lo"]), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), _hex("edited_").alias("edited_fingerprint"),
        likeness(_distance("", "edited_")).alias("near_edited"), likeness(_distance("", "next_")).alias("near_next"), "near_docs",
    )
