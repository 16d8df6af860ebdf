"""Words of texts, hashed, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MULTIPLIERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _byte_values(lower: bool) -> np.ndarray:
    v = mixed(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
    if lower:
        v[65:91] = v[97:123]
    return v


_VALUES = {lower: _byte_values(lower) for lower in (True, False)}
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, x, U)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def hashed_words(texts: list[str | None], lower: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (one more at the end).

    Words are runs of anything but space and the controls 9 to 13, or, with marks, but all of ASCII
    that is no letter or digit. With lower, A to Z are like a to z. A word's hash is a
    polynomial of its bytes modulo 2**64, mixed; from one running sum over all bytes.
    """
    space, values = _MARK if marks else _SPACE, _VALUES[lower]
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begin[1:]) if raw else None
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):  # cut after a space
            back = np.flatnonzero(space[data[at:end]][::-1][:4096])
            while not len(back) and end < len(data):
                end = min(len(data), end + _CHUNK)
                back = np.flatnonzero(space[data[at:end]][::-1])
            end -= int(back[0]) if len(back) else 0
        b = data[at:end]
        gap = np.concatenate(([True], space[b], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        s, e = edge[0::2], edge[1::2]
        power, inverse = _powers(max(len(b) + 1, _CHUNK + 1))
        total = np.zeros(len(b) + 1, U)
        np.cumsum(values[b] * power[: len(b)], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(U)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(raw) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts and the text of each; a text of 1 to k - 1 words is one shingle."""
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    h = np.zeros(len(words), U)
    for j in range(min(k, len(words))):
        m = len(words) - j
        h[:m] = mixed(h[:m] * _MULTIPLIERS[0] + words[j:] + U(j + 1))
    place = np.arange(len(words)) - at[:-1][of]
    full = place <= n[of] - k
    out, docs = [h[full]], [of[full]]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        s = np.zeros(len(short), U)
        for j in range(k):
            has = n[short] > j
            s[has] = mixed(s[has] * _MULTIPLIERS[1] + words[at[short[has]] + j] + U(j + 1))
        out.append(s)
        docs.append(short)
    return np.concatenate(out), np.concatenate(docs)


#: Texts that are looked at together at most, so that a text's number fits in OF_BITS bits.
OF_BITS = 12
MOST_TEXTS = 1 << OF_BITS


def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (of, value), sorted, and how often each comes: values, of, counts.

    of is below MOST_TEXTS. Values are cut to their upper 64 - OF_BITS bits, the same for all texts,
    so that one sort of plain numbers will do.
    """
    if not len(values):
        return values, of, np.zeros(0, np.int64)
    both = np.sort((of.astype(U) << U(64 - OF_BITS)) | (values >> U(OF_BITS)))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    n = np.diff(np.append(first, len(both)))
    both = both[first]
    return both & U((1 << (64 - OF_BITS)) - 1), (both >> U(64 - OF_BITS)).astype(np.int64), n


def slices(texts: list[str | None], most: int = 1 << 21):
    """Consecutive ranges of texts of about so many characters at most; a text is never split."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > start and (size + n > most or i - start >= MOST_TEXTS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
