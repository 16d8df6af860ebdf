import duckdb
from pyspark.sql import functions as F

from sparkvane.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id, piece, assistant, n_messages, n_masked, text, mask"


def both(spark, folder, rows):
    """The query's rows, which equal those of its SQL; the table has columns of names that the query uses."""
    sf = folder(conversations=spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("bucket", "PIECE", "pos", "one")}).repartition(3))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet/*.parquet')")
    got = sorted(map(tuple, chat.op2_chat_formatting(spark, sf).select(*COLUMNS.split(", ")).collect()), key=str)
    assert got == sorted(con.execute(f"select {COLUMNS} from ({chat.OP2_SQL})").fetchall(), key=str)
    return got


def test_messages_without_conversation_stand_alone(spark, folder):
    got = both(spark, folder, [(None, 1, "ann", "Hi é"), (None, 1, "bob", None), (None, None, "system", "x"), (None, 2, None, "y"), (None, 1, "ann", "Hi é"), (5, 0, "ann", "a"), (5, 1, "bob", "b")])
    assert [r for r in got if r[0] is None] == [(None, 0, "ann", 1, 5, "<|assistant|>Hi é\n", "13-18")] * 2 + [(None, 0, "bob", 1, 1, "<|assistant|>\n", "13-14"), (None, 0, "unknown", 1, 2, "<|assistant|>y\n", "13-15")]
    assert sum(r[0] == 5 for r in got) == 2


def test_long_texts_ties_and_repeated_rows(spark, folder):
    rows = [(1, 0, "ann", "long " * 100_000), (1, 0, "bob", "tied"), (1, 0, "bob", "tied"), (1, 3, "ann", "")]
    got = both(spark, folder, rows)
    assert [(r[2], r[3]) for r in got] == [("ann", 4), ("bob", 4)] and all(len(r[5]) > 500_000 for r in got)


def test_no_rows(spark, folder):
    assert both(spark, folder, []) == []
