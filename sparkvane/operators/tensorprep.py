"""Token rows for training: chat template, masks, batches, padding, exact evaluation split."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.functions.text import chat_turn

Tokenizer = Callable[[Column], Column]


def word_tokenizer(size: int = 50_000) -> Tokenizer:
    """A stand-in for a tokenizer: pieces of text that are no white space, hashed to ids. Not a real vocabulary."""
    return lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size)


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    """The tokenizer of a file, loaded once in a Python worker."""
    from tokenizers import Tokenizer as Loaded

    found = Loaded.from_file(path)
    found.encode_special_tokens = True  # what looks like a special token in a text is text
    return found


def file_tokenizer(path: str) -> Tokenizer:
    """A real vocabulary, from a tokenizers JSON file that every executor can read. Arrow batches, whole texts; null is empty."""

    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _vocabulary(path)
        for x in frames:
            yield pd.Series([e.ids for e in vocabulary.encode_batch(x.fillna("").tolist(), add_special_tokens=False)], dtype=object)

    encode.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(encode, "array<bigint>")
    return lambda text: udf(text)


def templated(rows: DataFrame) -> DataFrame:
    """rows and full_text, prefix_text; the prefix ends where the assistant begins."""
    prefix = F.concat(chat_turn("system", F.col("system_prompt")), chat_turn("user", F.col("user_query")))
    return rows.withColumns({"full_text": F.concat(prefix, chat_turn("assistant", F.col("assistant_response"))), "prefix_text": F.concat(prefix, F.lit("<|im_start|>assistant\n"))})


def masked(rows: DataFrame, tokenizer: Tokenizer, max_length: int = 2048) -> DataFrame:
    """rows and input_ids, attention_mask, labels: the prefix is masked by -100, everything cut on the right."""
    cut = rows.withColumns({"input_ids": F.slice(tokenizer(F.col("full_text")), 1, max_length), "__prefix": F.slice(tokenizer(F.col("prefix_text")), 1, max_length)})
    n = F.least(F.size("__prefix"), F.size("input_ids"))
    rest = F.size("input_ids") - n
    empty = F.array().cast("array<bigint>")
    tail = F.when(rest > 0, F.slice("input_ids", n + 1, F.greatest(rest, F.lit(1)))).otherwise(empty)
    return cut.withColumns({"attention_mask": F.array_repeat(F.lit(1).cast("bigint"), F.size("input_ids")), "labels": F.concat(F.array_repeat(F.lit(-100).cast("bigint"), n), tail)}).drop("__prefix")


def has_label() -> Column:
    return F.exists("labels", lambda x: x != -100)


def learnable(rows: DataFrame) -> DataFrame:
    return rows.where(has_label())


def mask_counters() -> dict[str, Column]:
    """Aggregates over masked rows: before, and after those without labels are left out."""
    return {"before": F.count(F.lit(1)), "after": F.coalesce(F.sum(has_label().cast("long")), F.lit(0))}


def mask_counts(rows: DataFrame) -> DataFrame:
    """Rows before, after and dropped, in one pass."""
    return rows.agg(*[c.alias(k) for k, c in mask_counters().items()]).withColumn("dropped", F.col("before") - F.col("after"))


def padded(rows: DataFrame, batch: Column, pad: int) -> DataFrame:
    """Every row padded on the right to the longest of its batch: ids by pad, mask by 0, labels by -100. Batches are small and bounded."""
    most = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    held = rows.withColumn("batch", batch).withColumn("__most", most)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("bigint"), F.col("__most") - F.size(c)))
    n = {"input_ids": pad, "attention_mask": 0, "labels": -100}
    made = held.select("*", *[fill(c, v).alias(f"__{c}") for c, v in n.items()])
    return made.drop(*n, "__most").withColumnsRenamed({f"__{c}": c for c in n})


def shuffled(key: str, seed: int) -> Column:
    """32 hexadecimal digits that put rows in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def batched(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """rows and batch: `size` rows in each, but for the last one, in a seeded order of a unique key.

    Rows are numbered within 4096 parts of the order, and the parts' numbers of rows are summed up.
    """
    held = rows.withColumn("__h", shuffled(key, seed)).withColumn("__part", F.substring("__h", 1, 3))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = held.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n")).select("__p", F.coalesce(before, F.lit(0)).alias("__before"))  # 4096 rows
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key)) - 1
    held = held.withColumn("__nth", nth).join(F.broadcast(counts), F.col("__part") == F.col("__p"))
    return held.withColumn("batch", F.floor((F.col("__before") + F.col("__nth")) / size)).drop("__h", "__part", "__p", "__before", "__nth")


#: Rows that are sorted at most to find where the evaluation rows end.
FEW = 10_000


def eval_split(rows: DataFrame, key: str, fraction: float, seed: int, least: int = 50) -> DataFrame:
    """rows and split: exactly ceil(n * fraction) rows are eval, those first in a seeded order, if there are `least` rows at all.

    Where eval ends is found digit by digit: rows are counted by three more digits of their hash, within
    the part that holds the last eval row, until few rows are left of it. No window or sort over all rows.
    """
    hashed = rows.withColumn("__h", shuffled(key, seed))
    n = rows.count()
    k = math.ceil(n * fraction) if fraction > 0 and n >= least else 0
    if not k:
        return hashed.withColumn("split", F.lit("train")).drop("__h")
    prefix, left, size = "", k, n
    while size > FEW and len(prefix) < 30:
        part = hashed.where(F.col("__h").startswith(prefix)).groupBy(F.substring("__h", len(prefix) + 1, 3).alias("p")).count()
        for p, size in sorted(tuple(r) for r in part.collect()):  # 4096 rows at most
            if left <= size:
                prefix += p
                break
            left -= size
    order = F.struct("__h", F.col(key))
    last = hashed.where(F.col("__h").startswith(prefix)).select(order.alias("o")).orderBy("o").limit(left).agg(F.max("o").alias("__last"))
    return hashed.crossJoin(F.broadcast(last)).withColumn("split", F.when(order <= F.col("__last"), "eval").otherwise("train")).drop("__h", "__last")  # last is one row
