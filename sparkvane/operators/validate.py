"""Validation of predictions, from raw JSON text read as VARIANT, so that missing fields and wrong types are seen.

Fields are those of the element itself, wherever and however they are written: in any order, with escapes, beside nested objects of
the same names; of a key that comes twice the last counts. What is no object, or no JSON, lacks every field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.functions.text import py_strip

REQUIRED = ["session_id", "user_id", "turn_number", "predicted_track_ids", "predicted_response"]
RULES = ["V02", "V03", "V04", "V05", "V06", "V07", "V08"]


def kind(v: Column) -> Column:
    """null, text, list, object, whole (a number, or true or false, that Python takes for an int) or number."""
    said = F.schema_of_variant(v)
    # a fraction like 1.0 is kept as a decimal of few digits, whole numbers only from 19 digits on
    whole = said.isin("BIGINT", "BOOLEAN") | said.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")
    return F.when(said == "VOID", "null").when(said == "STRING", "text").when(said.startswith("ARRAY"), "list").when(said.startswith("OBJECT"), "object").when(whole, "whole").otherwise("number")


def comparable(v: Column) -> Column:
    """A text that is equal for values that Python holds for equal: 1 and true are, 1 and "1" aren't; null for a missing value."""
    said = F.schema_of_variant(v)
    truth = F.when(F.try_variant_get(v, "$", "boolean"), "1").otherwise("0")
    return F.when(said == "BOOLEAN", F.concat(F.lit("n:"), truth)).when(said == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string"))).otherwise(F.concat(F.lit("n:"), F.coalesce(F.to_json(v), F.lit("null"))))


def violations(raw: DataFrame, expected: int = 80, n_ids: int = 20) -> DataFrame:
    """ordinal, rule of every failure, in a table (ordinal, raw). The number of rows is checked as ordinal -1."""
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    get = lambda c: F.try_variant_get("v", f"$.{c}", "variant")
    # each field is read once for a row
    fields = F.struct(*[get(c).alias(c) for c in REQUIRED])
    rows = raw.select("ordinal", F.explode(F.array(F.try_parse_json("raw"))).alias("v")).select("ordinal", F.explode(F.array(fields)).alias("f")).select("ordinal", "f.*")
    ids = F.when(kind(F.col("predicted_track_ids")) == "list", F.try_variant_get("predicted_track_ids", "$", "array<variant>"))
    ids = F.coalesce(F.transform(ids, lambda x: F.coalesce(comparable(x), F.lit("null"))), F.array().cast("array<string>"))
    same = Window.partitionBy(comparable(F.col("session_id")), comparable(F.col("turn_number"))).orderBy("ordinal")
    response = F.try_variant_get("predicted_response", "$", "string")
    missing = [F.col(c).isNull() for c in REQUIRED]
    tests = {
        "V03": F.array_contains(F.array(*missing), True),
        "V04": F.col("turn_number").isNotNull() & (kind(F.col("turn_number")) != "whole"),
        "V05": F.size(ids) != n_ids,
        "V06": F.size(F.array_distinct(ids)) != n_ids,
        "V07": F.coalesce(kind(F.col("predicted_response")) != "text", F.lit(True)) | (py_strip(F.coalesce(response, F.lit(""))) == ""),
        "V08": F.col("session_id").isNotNull() & F.col("turn_number").isNotNull() & (F.row_number().over(same) > 1),
    }
    held = rows.withColumns({f"__{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    each = held.select("ordinal", F.explode(F.array_compact(F.array(*[F.when(F.col(f"__{k}"), k) for k in tests]))).alias("rule"))
    count = raw.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(-1).cast("long").alias("ordinal"), F.lit("V02").alias("rule"))
    return count.unionByName(each)


def first_violation(found: DataFrame) -> DataFrame:
    """The one that a check in order of rows and rules stops at; no row if there is none."""
    return found.orderBy("ordinal", "rule").limit(1)
