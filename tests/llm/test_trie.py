import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """All nodes by the contract, from dictionaries of whole prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        again[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(again[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    """Conversations over few turns, so that they share beginnings; copies, gaps, nulls and ties."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 30), *range(100, 130), *range(205, 225), (1 << 60) + 1, (1 << 60) + 3]:
        same = rng.random() < 0.3
        for turn in range(rng.randrange(1, 9)):
            text = f"word {turn} é" if same else "word " * rng.randrange(3)
            rows.append((c, rng.choice([turn, turn * 600]) if seed % 2 else turn, rng.choice(["user", "user", None]) if not same else "user", text or None))
    return rows + [(7, None, "system", "first"), (7, None, "a", "tied"), (None, 0, "user", "nobody's"), (None, 0, "user", "nobody's")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_query_against_brute_force_and_sql(spark, folder, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("pos", "HEAD", "n", "conv")}).repartition(5)
    sf = folder(conversations=df)
    want = brute(rows)
    assert rows_of(trie.op13_prefix_trie(spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet/*.parquet')")
    order = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(con.execute(f"select {order} from ({trie.OP13_SQL})").fetchall(), key=str) == want


def small(spark, rows, limit, least):
    numbered = trie.numbered(spark.createDataFrame(rows, SCHEMA))
    found = trie.sequences(numbered, numbered.select("conv_id").limit(0))
    nodes = trie.trie(numbered, found, limit, least)
    out = nodes.join(found.select(F.col("conv").alias("end_conv"), "ends_sha256"), "end_conv", "left").fillna(trie._EMPTY, "ends_sha256")
    return rows_of(out.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"))


@pytest.mark.parametrize("limit", [1, 30])
def test_oversized_subtries_are_dealt_out_by_the_next_turn(spark, limit):
    """Every subtrie but the smallest is too large; one conversation is very long, one beginning is shared by most."""
    rng = random.Random(limit)
    rows = [(c, t, "u", f"shared {t}") for c in range(40) for t in range(6)]
    rows += [(c, 6 + t, "u", f"then {rng.randrange(3)}") for c in range(30) for t in range(4)]
    rows += [(9000, t, "u", f"a long one, {t % 7}") for t in range(5000)] + [(9100, t, "u", f"a long one, {t % 7}") for t in range(4998)]
    rows += [(10000 + c, 0, "u", f"alone {c}") for c in range(5)]
    assert small(spark, rows, limit, 1) == brute(rows, rebuild=False)


def test_ends_of_many_copies_are_hashed_in_order(spark):
    """Ids in many id strings, so that the hash is streamed."""
    rows = [(3 * c, 0, "u", "same") for c in range(-300, 2000)] + [(700_000, 1, "u", "other")]
    assert small(spark, rows, 50, 1) == brute(rows, rebuild=False)


def test_empty_table_and_only_nulls(spark, folder):
    sf = folder(conversations=spark.createDataFrame([(None, 1, "u", "x")], SCHEMA))
    assert trie.op13_prefix_trie(spark, sf).collect() == []


def test_a_long_text(spark, folder):
    rows = [(c, 0, "user", "long " * 200_000) for c in (1, 2, 3)]
    sf = folder(conversations=spark.createDataFrame(rows, SCHEMA))
    assert rows_of(trie.op13_prefix_trie(spark, sf)) == brute(rows)
