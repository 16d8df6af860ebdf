import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import line_runs

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, hashed=None):
    """(doc_id, n_lines, n_dropped, kept) by the contract; rows without id come last, by `hashed` of their texts."""
    order = [(i is None, i if i is not None else hashed[t]) for i, t in rows]
    first = {}
    for (_, text), at in zip(rows, order, strict=True):
        for line in (text or "").split("\n"):
            if len(k := key_of(line)) >= 10:
                first[k] = min(first.get(k, at), at)
    out = []
    for (i, text), at in zip(rows, order, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or first[key_of(x)] == at]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


TEXTS = [
    "a line that is common\nshort\n\nown line number one",
    "  A LINE that is Common \t\nshort\nÄ line that is common\nÄ LINE that is common",
    "a line that is common",
    "",
    None,
    "\n\n",
    "exactly 10\nexactly 9",
    "EXACTLY 10\nexactly 9\nlast",
    "twice in one document\nx\ntwice in one document",
    "twice in one document\r\n\x0btwice in one document\x0c",
    "a line that is common\n" * 3000 + "end of a long text",
]


@pytest.mark.parametrize("batches", [1, 3, 11])
def test_against_brute_force(spark, docs, batches):
    """Many batches, with runs compacted at each second one."""
    rows = [(i * 7 % 11, t) for i, t in enumerate(TEXTS)]
    found = line_runs.without_repeats(docs(rows).repartition(3), batches=batches, fanout=2)
    assert rows_of(found) == brute(rows)


def test_rows_without_id_and_repeated_ids(spark, docs):
    both = "this line is in several documents"
    rows = [(None, both), (None, both + "\nand this one only here, twice"), (None, both), (5, both + "\nfive"), (5, both), (5, both), (6, both)]
    only = [(None, "no document with an id has this line"), (None, "no document with an id has this line\nmore")]
    df = docs(rows + only)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    assert rows_of(line_runs.without_repeats(df)) == brute(rows + only, hashed)


def test_large_ids_beside_nulls(spark, docs):
    rows = [((1 << 60) + 1, "the very same line"), ((1 << 60) + 3, "the very same line"), (None, "the very same line")]
    assert [r[:3] for r in rows_of(line_runs.without_repeats(docs(rows)))] == [((1 << 60) + 1, 1, 0), ((1 << 60) + 3, 1, 1), (None, 1, 1)]


def test_query_equals_sql_and_reads_only_its_columns(spark, docs, folder):
    df = docs([(i, t) for i, t in enumerate(TEXTS)]).withColumns({c: F.lit(1) for c in ("own", "POS", "gone", "batch", "h1")})
    sf = folder(documents=df)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    found = rows_of(line_runs.op12_line_dedup(spark, sf))
    assert found == sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_runs.OP12_SQL})").fetchall(), key=str)
    assert found == sorted(((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(list(enumerate(TEXTS)))), key=str)


def test_empty_table(spark, docs):
    assert line_runs.without_repeats(docs([])).collect() == []


def test_runs_are_read_without_a_shuffle_and_compacted(spark, docs):
    runs = line_runs.Runs(spark, fanout=3)
    lines = line_runs.hashed_lines(docs([(i, f"a line of its own, number {i}\nthis one is everywhere") for i in range(40)]))
    for batch in range(5):
        gone = runs.add(lines.where(F.col("doc_id") % 5 == batch))
        assert gone.where(F.col("pos") == 1).count() == (7 if batch == 0 else 8)
        assert gone.where(F.col("pos") == 0).count() == 0
    assert [len(level) for level in runs.levels] == [2, 1]
    plan = runs.fresh(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
    names = runs.tables()
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in names]
