"""Ids of over 53 bits beside nulls, rows without id, and short test items."""

import random

import pytest

from sparkvane.llm import decontamination, fingerprints, jaccard_join
from sparkvane.llm.jaccard_join import Rule

BIG = 1 << 60


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fingerprints_keep_large_ids(spark, docs, folder):
    ids = [BIG + 1, BIG + 3, None, -BIG - 1]
    found = fingerprints.op6_fingerprints(spark, folder(documents=docs([(i, f"text of its own {i}") for i in ids]).coalesce(1)))
    assert sorted(map(str, (r.doc_id for r in found.collect()))) == sorted(map(str, ids))


def test_leaks_keep_large_ids(spark, docs):
    text = " ".join(f"w{n}" for n in range(20))
    ids, items = [BIG + 1, BIG + 3, None], [BIG + 5, BIG + 7, None]
    benchmark = spark.createDataFrame([(i, text) for i in items], "item_id long, text string").coalesce(1)
    found = decontamination.contaminated(docs([(i, f"x {text} y") for i in ids]).coalesce(1), benchmark)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted(((d, i) for d in ids for i in items), key=str)


def test_short_items_match_verbatim(spark, docs):
    items = [(1, "one two three four"), (2, "five six"), (3, "A, b! c d e f g"), (4, "five six"), (5, "word"), (6, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = ["zero ONE two, three four five", "one two three", "four one two three", "Five  SIX!", "five six seven", "a b c d e f g h a b c d e f g", "word", "word word", "", None]
    found = decontamination.contaminated(docs([(n, t) for n, t in enumerate(texts)]).coalesce(1), benchmark)
    assert sorted((r.doc_id, r.item_id, r.score, r.end_word) for r in found.collect()) == [(0, 1, 1.0, 5), (3, 2, 1.0, 2), (3, 4, 1.0, 2), (5, 3, 1.0, 7), (6, 5, 1.0, 1)]
    left = decontamination.without_leaks(docs([(n, t) for n, t in enumerate(texts)]), benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 7, 8, 9]


def words(text):
    return (text or "").split()


def brute(rows, rule):
    """(doc_id, n_shingles, component_id); a row without id is a document of its own, but for equal texts."""
    nodes = [i if i is not None else ("none", t) for i, t in rows]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + rule.words]) for j in range(max(1, len(w) - rule.words + 1))} if w else set())
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and rule.den * len(sets[x] & sets[y]) >= rule.num * len(sets[x] | sets[y]):
                up[top(nodes[x])] = top(nodes[y])
    names = {}
    for n in nodes:
        if isinstance(n, int):
            names[top(n)] = min(n, names.get(top(n), n))
    return sorted(((i, len(s), names.get(top(n))) for (i, _), n, s in zip(rows, nodes, sets, strict=True)), key=str)


def test_rows_without_id_link_by_their_texts_alone(docs):
    """Two groups that only share that one of their rows has no id."""
    a, b = " ".join(f"a{n}" for n in range(60)), " ".join(f"b{n}" for n in range(60))
    rows = [(None, a), (None, b), (1, a + " x"), (2, b + " y")]
    assert rows_of(jaccard_join.classes(docs(rows))) == brute(rows, Rule()) == sorted([(None, 57, 1), (None, 57, 2), (1, 58, 1), (2, 58, 2)], key=str)


@pytest.mark.parametrize("seed", range(2))
def test_null_and_large_ids_against_brute_force(docs, seed):
    rng, rows = random.Random(seed), []
    for n in range(120):
        w = rng.choice(rows)[1].split() if rows and n % 3 else [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([3, 20, 60]))]
        for _ in range(rng.randrange(3) if n % 4 else 0):
            w[rng.randrange(len(w))] = "new"
        rows.append((rng.choice([None, n, BIG + n, -(1 << 63) + n, (1 << 63) - 1 - n]), " ".join(w)))
    rows += [(None, ""), (None, None), (None, "  ")]
    assert rows_of(jaccard_join.classes(docs(rows))) == brute(rows, Rule())
