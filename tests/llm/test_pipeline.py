"""The pipeline's stages on a small corpus, and its registration."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
from sparkvane.llm import common, jaccard_join, mixing, sharding, stages, toxicity
from test_operators import classes, local, plain_score

NAMES = ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_keep_columns_and_take_effect(spark, docs, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    rng = random.Random(0)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item = prose(30)
    rows = [(i, prose(60), "ab"[i % 2]) for i in range(100)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, f"{prose(20)} {item}"), (203, None), (204, ""), (3, rows[3][1], "b"), (None, "no id"), (None, "no id")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sf_dir = folder(documents=docs(rows), labels=labels, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    held = docs(rows)
    assert stages.drop_toxic(spark, held, sf_dir).count() == len(rows)
    held = stages.drop_near_duplicates(spark, held, sf_dir)
    ids = [r["doc_id"] for r in held.collect()]
    assert 200 not in ids and 201 not in ids and ids.count(3) == 1 and ids.count(None) == 2 and {202, 203, 204} <= set(ids)
    held = stages.drop_contaminated(spark, held, sf_dir)
    assert {r["doc_id"] for r in held.collect()} == set(ids) - {202}
    mixed = stages.mix_sources(spark, held, sf_dir)
    assert mixed.columns == held.columns
    before = set(common.made())
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(set(common.made()) - before) == 1  # the table that the last stage reads
    assert out.count() == mixed.count() and {"shard", "slot"} <= set(out.columns)


def test_stages_carry_columns_of_any_name(spark, docs, folder):
    """Names that helper columns would like, in other cases too."""
    rng = random.Random(2)
    names = ["__score", "__LEAK", "__doc_id", "__nth", "__at", "__part", "__one", "__gone", "__again", "__row", "__id", "__taken_source", "__inside", "__bucket", "__key0", "a.b"]
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(60)]
    held = docs([*rows, (7, rows[7][1] + " again"), (60, rows[5][1])])
    for k, name in enumerate(names):
        held = held.withColumn(name, held["doc_id"] * 10 + k)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sf_dir = folder(labels=labels, benchmark=spark.createDataFrame([(1, rows[3][1])], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, sf_dir)
        assert set(names) <= set(held.columns), name
    got = [r.asDict() for r in held.collect()]
    assert got and all(r[n] == r["doc_id"] * 10 + k for r in got for k, n in enumerate(names))
    assert {r["doc_id"] for r in got} == set(range(60)) - {3}


def test_stages_against_plain_ones(spark, docs, folder):
    """Every stage's rows on its own input, from the plain versions of the operators' tests and from SQL."""
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, prose(20)) for i in range(6)]
    rows, labels = [], []
    for i in range(160):
        t = prose(rng.choice([3, 30, 60]))
        if i % 5 == 0:
            t = f"{t} horrible horrible horrible horrible"
        labels.append((i, 1, int(i % 5 == 0)))
        if i % 8 == 1 and rows:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 13 == 2:
            t = f"{t} {' '.join('x' if k % 4 == 3 else w for k, w in enumerate(rng.choice(items)[1].split()))}"
        rows.append((i, t, "abc"[i % 3]))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sf_dir = folder(labels=labels, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    plain = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    held = docs(rows)
    model = toxicity.train(held, labels)
    want = {i: t for i, t in plain(held).items() if plain_score(t, *model) < 0.5}
    held = common.written(stages.drop_toxic(spark, held, sf_dir))
    assert plain(held) == want and 80 < len(want) < 160

    found = classes(list(want.items()), jaccard_join.Rule(words=5, num=80, den=100))
    want = {i: t for i, t in want.items() if found[i][1] == i}
    held = common.written(stages.drop_near_duplicates(spark, held, sf_dir))
    assert plain(held) == want and any(found[i][1] != i for i in found)

    leak = lambda t: any(local(i.split(), t.split()) >= 0.5 * 2 * 20 for _, i in items)
    clean = {i: t for i, t in want.items() if not leak(t)}
    held = common.written(stages.drop_contaminated(spark, held, sf_dir))
    assert plain(held) == clean and len(clean) < len(want)

    con = duckdb.connect()
    documents = held.toPandas()  # noqa: F841  read by DuckDB
    copies = {r[0]: r[1] for r in con.sql(f"select doc_id, copies from ({mixing.OP4_SQL})").fetchall()}
    mixed = common.written(stages.mix_sources(spark, held, sf_dir))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    documents = mixed.toPandas()  # noqa: F841
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    got = sorted(tuple(r[n] for n in names) for r in stages.shard(spark, mixed, sf_dir).collect())
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({sharding.OP9_SQL})").fetchall())


def test_stages_of_empty_tables(spark, docs, folder):
    sf_dir = folder(documents=docs([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
