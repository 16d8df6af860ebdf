"""Removal of long repeated byte strings, by prefix-free parsing.

Every document is parsed into phrases. A rolling hash of ANCHOR bytes has a trigger wherever it is least
among those of some LENGTH-byte window; a phrase is the union of neighbouring windows with the same
trigger. So phrases overlap by LENGTH - 1 bytes, each window, the suffix of the corpus that begins
there cut to LENGTH bytes, lies whole in one phrase, and equal windows have equal triggers. The dictionary
is the set of different phrases, the parse tells the documents of each. Then:

1. Parse: a trigger that occurs once in the corpus has a phrase that shares no window; it is done.
2. Dictionary: the other phrases meet by trigger, as bytes. Phrases of equal bytes become one, for the
   least of their documents. The suffixes of the dictionary, cut to LENGTH bytes, are sorted by
   their bytes, equal ones by the documents of the parse: that is the order of the corpus. What
   stands in a run of equal suffixes after a smaller document is repeated.
3. The answers go back to the documents, whose removed bytes are the union of their repeated windows.

As phrases overlap by LENGTH - 1 bytes, a suffix never runs on into the next phrase before it is cut, so
that of the parse's own suffix order no more than the documents of a phrase can matter.
Hashes say only who meets whom and which suffixes stand alone; whatever is removed was compared byte by byte.

Documents are dealt to blocks of about BLOCK bytes by a hash of their id; one exchange of the texts
serves all passes, and phrases are cut once, in the first. Blocks combine what they send: one entry for
a trigger or phrase. A trigger with over HOT phrases, as at the edge of a very common line, is not one
task's group: its windows are sent alone, each as a phrase of its own, dealt by a hash of their bytes.

Defined cases. A null text has no bytes. A null doc_id is greater than all others. Rows of one doc_id do not
remove each other's bytes, repeated rows get equal results. Texts under LENGTH bytes lose nothing.
An empty table gives an empty result. Only doc_id and text are read. A document is never split: a task needs
about 40 bytes of memory for each byte of its longest document.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm.common import freed, read
from sparkvane.llm.words import U, mixed

LENGTH, ANCHOR = 50, 20
#: Bytes of text in a block, and of all text to a part of the triggers and of the dictionary. All grow with the
#: root of the input over WIDE bytes, up to MOST times (the dictionary's up to half of that), so that messages are fewer.
BLOCK, TRIGGERS, DICTIONARY = 2 << 20, 12 << 20, 4 << 20
WIDE, MOST = 1 << 30, 4
#: Phrases of a trigger, over all blocks, from which its windows are sent alone.
HOT = 20_000
#: Bits of a trigger's hash that decide who meets; fewer only make more phrases meet.
KEY_BITS = 48
TILE = 1 << 17
NO_ID = (1 << 63) - 1
_BASE = 0x2545F4914F6CDD1D
_VALUES = mixed(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each place on."""
    have, n = {1: _VALUES[data]}, 1
    while 2 * n <= length:
        p = U(pow(_BASE, n, 1 << 64))
        x = have[n]
        have[2 * n] = x[: len(x) - n] * p + x[n:] if len(x) > n else x[:0]
        n *= 2
    out, rest = have[n], length - n
    done = n
    while rest:
        n = 1 << (rest.bit_length() - 1)
        y = have[n][done:]
        m = min(len(out), len(y))
        out = out[:m] * U(pow(_BASE, n, 1 << 64)) + y[:m]
        done, rest = done + n, rest - n
    return out[: max(0, len(data) - length + 1)]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = 1
    while n < width:
        s = min(n, width - n)
        x = np.minimum(x[: len(x) - s], x[s:])
        n += s
    return x


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n numbers in a row from each first on."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


@dataclass
class Block:
    """Documents in the order of their ids: their bytes, where each one's begin and the end, and hashes of all ANCHOR bytes."""

    ids: np.ndarray
    raw: bytes
    at: np.ndarray
    anchors: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, texts: list[str | None], hashed: bool = True) -> Block:
        several = len(np.unique(ids)) < len(ids)
        order = np.lexsort(([t or "" for t in texts], ids)) if several else np.argsort(ids)
        each = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order]
        at = np.concatenate(([0], np.cumsum([len(r) for r in each]))).astype(np.int64)
        raw = b"".join(each)
        data = np.frombuffer(raw, np.uint8)
        anchors = np.zeros(max(0, len(raw) - ANCHOR + 1) if hashed else 0, U)
        for s in range(0, len(anchors), TILE):
            e = min(len(anchors), s + TILE)
            anchors[s:e] = mixed(_rolling(data[s : e + ANCHOR - 1], ANCHOR))
        return cls(ids[order], raw, at, anchors)

    def phrases(self) -> np.ndarray:
        """The first window of every phrase, in order."""
        n = max(0, len(self.raw) - LENGTH + 1)
        if not n:
            return np.zeros(0, np.int64)
        width = LENGTH - ANCHOR + 1
        inside, new = np.ones(n, bool), np.ones(n, bool)
        for end in self.at[1:-1]:  # no window goes on into the next document
            inside[max(0, end - LENGTH + 1) : end] = False
        before = U(0)
        for s in range(0, n, TILE):
            e = min(n, s + TILE)
            low = _least(self.anchors[s : e + width - 1], width)
            new[s:e] = np.concatenate(([s == 0 or low[0] != before], low[1:] != low[:-1]))
            before = low[-1]
        new[1:] |= ~inside[:-1]
        return np.flatnonzero(new & inside)

    def windows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase: its document, and how many windows it has."""
        doc = np.searchsorted(self.at, first, "right") - 1
        stop = self.at[doc + 1] - LENGTH + 1
        return doc, np.minimum(np.append(first[1:], stop[-1:]), stop) - first

    def keys(self, first: np.ndarray) -> np.ndarray:
        """KEY_BITS bits of each phrase's trigger."""
        if not len(first):
            return np.zeros(0, U)
        low = np.empty(len(first), U)
        step = TILE // 8
        for s in range(0, len(first), step):
            f = first[s : s + step]
            edges = np.empty(2 * len(f), np.int64)
            edges[::2], edges[1::2] = f, f + LENGTH - ANCHOR + 1
            part = self.anchors[: edges[-1] + 1]
            low[s : s + step] = np.minimum.reduceat(part if edges[-1] < len(part) else np.append(part[f[0] :], U((1 << 64) - 1)), edges if edges[-1] < len(part) else edges - f[0])[::2]
        return mixed(low) >> U(64 - KEY_BITS)  # least values are small ones; mixed they are even


def _planes(x: np.ndarray, n: int) -> bytes:
    """The lower n bytes of numbers, byte by byte: what is alike stands together."""
    return np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def _numbers(b: bytes, n: int, kind=U) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view(kind)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys are cut into parts."""
    return np.searchsorted(_part(keys, parts), np.arange(parts + 1).astype(U))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    wide = keys >> U(KEY_BITS - 32) if KEY_BITS > 32 else keys << U(32 - KEY_BITS)
    return (wide * U(parts)) >> U(32)


#: kind 0: for a part, and its answers. kind 1: what a block tells itself, passed through.
_SENT = "blk int, part int, kind int, payload binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["blk", "part", "kind", "payload"])


def _block(x: pd.DataFrame, hashed: bool = True) -> Block:
    freed()
    return Block.of(x["doc_id"].to_numpy(np.int64), x["text"].tolist(), hashed)


def _own(x: pd.DataFrame) -> bytes:
    return b"".join(x[x["kind"] == 1]["payload"])


def _answers(x: pd.DataFrame) -> list[bytes]:
    return list(x[x["kind"] == 0].sort_values("part")["payload"])


def _parse(parts: int):
    """Each block's triggers, once, and in how many different phrases they stand."""

    def block(x: pd.DataFrame) -> pd.DataFrame:
        b, blk = _block(x), int(x["blk"].iloc[0])
        first = b.phrases()
        rows = [(blk, blk % parts, 1, _planes(np.diff(first, prepend=0), 4))]
        if len(first):
            key, (_, n) = b.keys(first), b.windows(first)
            looks = mixed(b.anchors[first] + mixed(b.anchors[first + n - 1 + LENGTH - ANCHOR] + n.astype(U)))
            order = np.lexsort((looks, key))
            k, s = key[order], looks[order]
            head = np.concatenate(([True], k[1:] != k[:-1]))
            kinds = np.add.reduceat(head | np.concatenate(([True], s[1:] != s[:-1])), np.flatnonzero(head), dtype=np.int64)
            k, kinds = k[head], np.minimum(kinds, 255).astype(np.uint8)
            cut = _cuts(k, parts)
            rows += [(blk, j, 0, _planes(k[a:e], 6) + kinds[a:e].tobytes()) for j, (a, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > a]
        return _frame(rows)

    return block


def _met(x: pd.DataFrame) -> pd.DataFrame:
    """For every trigger sent: 0 no other block has it, 1 others have, 2 it is hot."""
    freed()
    own, x = x[x["kind"] == 1], x[x["kind"] == 0]
    if not len(x):
        return own
    size = [len(p) // 7 for p in x["payload"]]
    k = np.concatenate([_numbers(p[: 6 * n], 6) for p, n in zip(x["payload"], size, strict=True)])
    kinds = np.concatenate([np.frombuffer(p[6 * n :], np.uint8) for p, n in zip(x["payload"], size, strict=True)])
    order = np.argsort(k)
    ks = k[order]
    head = np.concatenate(([True], ks[1:] != ks[:-1]))
    first = np.flatnonzero(head)
    state = np.where(np.add.reduceat(kinds[order], first, dtype=np.int64) > HOT, 2, np.where(np.diff(np.append(first, len(ks))) > 1, 1, 0))
    out = np.empty(len(k), np.uint8)
    out[order] = state[np.cumsum(head) - 1]
    at = np.concatenate(([0], np.cumsum(size)))
    return pd.concat([own, _frame([(b, j, 0, out[p:q].tobytes()) for b, j, p, q in zip(x["blk"], x["part"], at[:-1], at[1:], strict=True)])])


def _asked(parts: int):
    """The phrases of triggers that come several times, each once and for its least document here; and where they stand."""

    def block(x: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return _frame([])
        b, blk = _block(x), int(x["blk"].iloc[0])
        first = np.cumsum(_numbers(_own(sent), 4, np.int64))
        if not len(first):
            return _frame([(blk, blk % parts, 1, b"")])
        key, (doc, n) = b.keys(first), b.windows(first)
        _, kind, times = np.unique(key, return_inverse=True, return_counts=True)
        state = np.frombuffer(b"".join(_answers(sent)), np.uint8)[kind]
        ask = (state > 0) | (times[kind] > 1)
        some = np.flatnonzero(ask & (state < 2))
        to = _part(key[some], parts).astype(np.int64)
        # windows of hot triggers, one by one
        hot = np.flatnonzero(state == 2)
        alone = _ranges(first[hot], n[hot])
        f, d = np.concatenate([first[some], alone]), np.concatenate([doc[some], np.repeat(doc[hot], n[hot])])
        n = np.concatenate([n[some], np.ones(len(alone), np.int64)])
        raw, found, entry = b.raw, {}, np.empty(len(f), np.int64)
        for i, (p, q) in enumerate(zip(f.tolist(), (f + n + LENGTH - 1).tolist(), strict=True)):
            entry[i] = found.setdefault(raw[p:q], len(found))
        phrases = list(found)
        del found
        _, where = np.unique(entry, return_index=True)
        least = np.full(len(phrases), NO_ID)
        np.minimum.at(least, entry, b.ids[d])
        lengths = n[where] + LENGTH - 1
        to = np.concatenate([to, np.zeros(len(alone), np.int64)])[where]
        for e in np.flatnonzero(where >= len(some)).tolist():
            to[e] = (zlib.crc32(phrases[e]) * parts) >> 32
        order = np.argsort(to, kind="stable")
        rows = []
        edge = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) > 0, [True]))) if len(order) else [0]
        for p, q in zip(edge[:-1], edge[1:], strict=True):
            g = order[p:q]
            rows.append((blk, int(to[g[0]]), 0, len(g).to_bytes(4, "little") + _planes(lengths[g], 4) + _planes(least[g], 8) + b"".join([phrases[e] for e in g.tolist()])))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        told = np.argsort(f, kind="stable")
        own = len(told).to_bytes(4, "little") + _planes(np.diff(f[told], prepend=0), 4) + _planes(n[told], 4) + _planes(place[entry[told]], 4) + (b.ids[d] > least[entry])[told].tobytes()
        return _frame([*rows, (blk, blk % parts, 1, own)])

    return block


def repeated(phrases: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different phrases and the least document of each: whether a smaller document has the window, for all windows in a row, and where each phrase's begin.

    The suffix array of the dictionary, its suffixes cut to LENGTH bytes. Suffixes whose hash no
    other has stand alone; the others are sorted by their bytes, then by document.
    """
    size = np.array([len(p) for p in phrases], np.int64)
    n = size - LENGTH + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    data = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    total = len(data) - 8
    starts = _ranges(np.concatenate(([0], np.cumsum(size)[:-1])), n)
    word = np.zeros(total, U)
    for k in range(8):
        word = (word << U(8)) | data[k : k + total]
    offsets = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    h = np.zeros(len(starts), U)
    for o in offsets:
        h = mixed(h + word[starts + o])
    order = np.argsort(h)
    hs = h[order]
    same = hs[1:] == hs[:-1]
    some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    del h, hs, order
    out = np.zeros(len(starts), bool)
    if len(some):
        doc = np.repeat(docs, n)[some]
        words = [word[starts[some] + o] for o in offsets]
        order = np.lexsort((doc, *words[::-1]))  # the order of the corpus
        new = np.zeros(len(some), bool)
        new[0] = True
        for w in words:
            w = w[order]
            new[1:] |= w[1:] != w[:-1]
        doc = doc[order]
        out[some[order]] = doc[np.flatnonzero(new)][np.cumsum(new) - 1] < doc
    return out, begin


def _dictionary(x: pd.DataFrame) -> pd.DataFrame:
    """For every phrase sent: 0 none of its windows is repeated, 1 all are, 2 those of the bits that follow."""
    freed()
    own, x = x[x["kind"] == 1], x[x["kind"] == 0]
    if not len(x):
        return own
    found: dict[bytes, int] = {}
    which, docs, ends = [], [], [0]
    for p in x["payload"]:
        m = int.from_bytes(p[:4], "little")
        lengths = _numbers(p[4 : 4 + 4 * m], 4, np.int64)
        docs.append(_numbers(p[4 + 4 * m : 4 + 12 * m], 8, np.int64))
        at = (4 + 12 * m + np.concatenate(([0], np.cumsum(lengths)))).tolist()
        which += [found.setdefault(p[a:e], len(found)) for a, e in zip(at[:-1], at[1:], strict=True)]
        ends.append(ends[-1] + m)
    which, docs = np.array(which, np.int64), np.concatenate(docs)
    least = np.full(len(found), NO_ID)
    np.minimum.at(least, which, docs)
    bits, begin = repeated(list(found), least)
    some = np.add.reduceat(bits, begin[:-1], dtype=np.int64) > 0
    state = np.where(docs > least[which], 1, np.where(some[which], 2, 0)).astype(np.uint8)
    rows = []
    for blk, part, a, e in zip(x["blk"], x["part"], ends[:-1], ends[1:], strict=True):
        w = which[a:e][state[a:e] == 2]
        held = bits[_ranges(begin[w], begin[w + 1] - begin[w])]
        rows.append((blk, part, 0, (e - a).to_bytes(4, "little") + state[a:e].tobytes() + np.packbits(held).tobytes()))
    return pd.concat([own, _frame(rows)])


def _removed(b: Block, own: bytes, answers: list[bytes]) -> np.ndarray:
    """Which bytes of a block go."""
    m = int.from_bytes(own[:4], "little")
    first, n, place = np.cumsum(_numbers(own[4 : 4 + 4 * m], 4, np.int64)), _numbers(own[4 + 4 * m : 4 + 8 * m], 4, np.int64), _numbers(own[4 + 8 * m : 4 + 12 * m], 4, np.int64)
    later = np.frombuffer(own[4 + 12 * m :], bool)
    if not m:
        return np.zeros(len(b.raw), bool)
    counts = [int.from_bytes(p[:4], "little") for p in answers]
    state = np.concatenate([np.frombuffer(p[4 : 4 + c], np.uint8) for p, c in zip(answers, counts, strict=True)])
    # of every phrase with bits: where they begin
    length = np.zeros(len(state), np.int64)
    length[place] = n
    asked = np.where(state == 2, length, 0)
    bits, at, start = [], 0, np.zeros(len(state), np.int64)
    for p, c, e in zip(answers, counts, np.cumsum(counts).tolist(), strict=True):
        k = int(asked[e - c : e].sum())
        start[e - c : e] = at + np.concatenate(([0], np.cumsum(asked[e - c : e])[:-1]))
        bits.append(np.unpackbits(np.frombuffer(p[4 + c :], np.uint8), count=k).astype(bool))
        at += k
    bits = np.concatenate(bits)
    whole = later | (state[place] == 1)
    part = ~whole & (state[place] == 2)
    s = _ranges(first[part], n[part])
    s = s[bits[_ranges(start[place[part]], n[part])]]
    edge = np.zeros(len(b.raw) + 1, np.int64)
    for p, q in ((first[whole], first[whole] + n[whole] + LENGTH - 1), (s, s + LENGTH)):
        edge += np.bincount(p, minlength=len(edge))
        edge -= np.bincount(q, minlength=len(edge))
    return np.cumsum(edge)[:-1] > 0


def _result(with_bytes: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_bytes]

    def block(x: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({n: [] for n in names})
        b = _block(x, hashed=False)
        gone = _removed(b, _own(sent), _answers(sent))
        rows = []
        for doc, a, e in zip(b.ids, b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
            g = np.concatenate(([False], gone[a:e], [False]))
            edge = np.flatnonzero(g[1:] != g[:-1]).tolist()
            kept = b"".join([b.raw[a + p : a + q] for p, q in zip([0, *edge[1::2]], [*edge[::2], e - a], strict=True)])
            rows.append((doc, e - a, e - a - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge, *[kept] * with_bytes))
        return pd.DataFrame(rows, columns=names)

    return block


def repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in turn), and, if asked for, kept (the bytes left)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wide = min(MOST, max(1.0, (size / WIDE) ** 0.5))
    blocks, triggers, dictionary = (int(size / n) + 1 for n in (BLOCK * wide, TRIGGERS * wide, DICTIONARY * max(1.0, wide / 2)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * with_bytes
    met = rows.groupBy("blk").applyInPandas(_parse(triggers), _SENT).groupBy("part").applyInPandas(_met, _SENT)
    answered = rows.groupBy("blk").cogroup(met.groupBy("blk")).applyInPandas(_asked(dictionary), _SENT).groupBy("part").applyInPandas(_dictionary, _SENT)
    out = rows.groupBy("blk").cogroup(answered.groupBy("blk")).applyInPandas(_result(with_bytes), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document. Null texts have no bytes, repeated rows equal results, no rows give none."""
    return repeats(read(spark, sf_dir, "documents")).drop("spans")
