"""The search for fingerprints within a radius, by tables of blocks, against plain comparison."""

import random

import numpy as np
import pytest

from sparkvane.llm import fingerprints
from sparkvane.llm.fingerprints import BLOCKS, BlockTables
from sparkvane.llm.words import U


def halves(fps):
    return np.array([f >> 64 for f in fps], U), np.array([f & ((1 << 64) - 1) for f in fps], U)


def planted(seed, n, most):
    """Fingerprints, and others up to `most` bits from them, many at just that distance, their bits in few blocks or in many."""
    rng = random.Random(seed)
    base = [rng.getrandbits(128) for _ in range(n)] + [0, (1 << 128) - 1]
    out = []
    for b in base:
        for _ in range(8):
            bits = rng.sample(range(128) if rng.random() < 0.5 else range(rng.choice([0, 64]), 128 if rng.random() < 0.5 else 100), rng.choice([most, most + 1, rng.randrange(most + 1)]))
            out.append(b ^ sum(1 << k for k in bits))
    return base, out + base[:3]


@pytest.mark.parametrize("radius", [7, 13, 28])
@pytest.mark.parametrize("checked", [1 << 20, 20])
def test_all_pairs_within_the_radius_are_found_once(radius, checked, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHECKED", checked)
    asked, rows = planted(radius, 25, radius)
    tables = BlockTables.of(*halves(asked), radius)
    got = [(int(r), int(q)) for a, b in tables.near(*halves(rows)) for r, q in zip(a, b, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(rows) for j, y in enumerate(asked) if (x ^ y).bit_count() <= radius}


def test_the_radius_is_shared_out_among_the_blocks():
    """Were every block to differ in one bit more than it is searched for, the distance would be over the radius."""
    for radius in range(fingerprints.TABLES + 1, 33):
        tables = BlockTables.of(*halves([0]), radius)
        assert sum(max(int(m).bit_count() for m in masks) + 1 for masks in tables.masks) == radius + 1 and len(tables.masks) == BLOCKS


def test_counts_equal_a_scan(spark, monkeypatch):
    asked, rows = planted(5, 30, 28)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = lambda fps: spark.createDataFrame([(f"{f:032x}", signed(f >> 64), signed(f & (1 << 64) - 1)) for f in fps], "fp string, hi long, lo long")
    monkeypatch.setattr(fingerprints, "QUERIES", 10)
    monkeypatch.setattr(fingerprints, "LOOKED_UP", 7)
    key = lambda df: sorted(map(tuple, df.select("q_hi", "q_lo", "n").collect()))
    got = key(fingerprints.near_counts(frame(asked), frame(rows + rows[:9]), 28))
    assert got == key(fingerprints.scanned(frame(asked), frame(rows + rows[:9]), 28)) and len(got) >= 30
    assert key(fingerprints.near_counts(frame(asked[:0]), frame(rows), 28)) == [] == key(fingerprints.near_counts(frame(asked), frame(rows[:0]), 28))
