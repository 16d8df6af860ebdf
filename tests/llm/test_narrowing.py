"""Coarse components that passages in common chain are parted before their blocks are checked."""

import numpy as np
import pandas as pd

from sparkvane.llm import jaccard_join
from sparkvane.llm.words import U


def chained():
    """Documents of which two thirds are one passage, each with a near copy."""
    shared = " ".join(f"s{i}" for i in range(70))
    texts = [shared + " " + " ".join(f"d{d}x{i}" for i in range(33)) for d in range(60)]
    return [(d, t) for d, t in enumerate(texts)] + [(100 + d, t + " end") for d, t in enumerate(texts)]


def test_chains_are_parted_before_blocks_are_checked(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WHOLE", 1000)
    outside, asked = jaccard_join._outside, []
    monkeypatch.setattr(jaccard_join, "_outside", lambda first, fine: asked.append(first.count()) or outside(first, fine))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs(chained())).collect()}
    assert got == {d: d % 100 for d, _ in chained()}
    assert not asked  # no pair of blocks: their number grows with the square of such a component


def test_sets_that_link_have_a_prefix_key_in_common():
    rng, rule = np.random.default_rng(5), jaccard_join.Rule(words=5, num=80)
    counts, table = rng.integers(0, 9, jaccard_join.COUNTERS).astype(np.uint16), jaccard_join.bands(rule, 1 << 10)
    linked = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 52, rng.integers(1, 60)).astype(U))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 52, rng.integers(0, 6)).astype(U)]))
        if not len(b) or not rule.links(len(a), len(b), len(np.intersect1d(a, b))):
            continue
        linked += 1
        keys, sets = jaccard_join.prefix_keys(rule, np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), table, counts)
        assert len(np.intersect1d(keys[sets == 0], keys[sets == 1]))
    assert linked > 50


def test_matrices_and_breadth_first_connect_alike(monkeypatch):
    rng, rule = np.random.default_rng(6), jaccard_join.Rule(words=5, num=80)
    for size in (7, 2048):
        monkeypatch.setattr(jaccard_join, "DENSE_SETS", max(size, 40))
        for _ in range(20):
            base = rng.integers(0, 1 << 52, 100).astype(U)
            sets = [np.unique(np.concatenate([base[rng.random(100) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 52, 3).astype(U)])) for _ in range(30)]
            found = jaccard_join._all_links(sets, np.array([len(s) for s in sets]), rule)
            with monkeypatch.context() as m:
                m.setattr(jaccard_join, "_all_links", lambda *x: None)
                plain = jaccard_join.spanning_links(sets, rule)
            forest = lambda x: [p.tolist() for p in jaccard_join._forest(*np.array(x, np.int64).reshape(-1, 2).T)]
            assert forest(found) == forest(plain)


def test_packed_keys_come_back():
    rng = np.random.default_rng(7)
    keys, sets, ids = rng.integers(0, 1 << 63, 5000).astype(U), rng.integers(0, 50, 5000), rng.integers(-(1 << 62), 1 << 62, 50)
    keys[4000:] = keys[:1000]
    frames = list(jaccard_join._packed(keys, sets, ids))
    a, b = (np.concatenate([x[c].to_numpy() for x in jaccard_join._met(iter([pd.concat(frames)]))]) for c in "ab")
    first = {}
    pairs = [(int(ids[s]), int(ids[first.setdefault(int(k), s)])) for k, s in zip(keys, sets, strict=True)]
    want = jaccard_join._forest(*np.array(pairs, np.int64).T)
    assert [a.tolist(), b.tolist()] == [x.tolist() for x in want]
