"""Sources and sinks: table registry, optional tables, schemas, keyed dimensions, text, JSON and zip files, previews."""

from __future__ import annotations

import json
import os
import zipfile
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.functions.text import rendered

TURN = "struct<turn_number:int,role:string,content:string>"
SESSIONS = f"session_id string, user_id string, user_profile string, conversation_goal string, conversations array<{TURN}>"
TRACKS = "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, release_date array<string>, tag_list array<string>"
USERS = "user_id string, age_group string, gender string, country_name string"
PREDICTIONS = "session_id string, user_id string, turn_number int, predicted_track_ids array<string>, predicted_response string"


@dataclass(frozen=True)
class TableSpec:
    """A table of the registry; split is a column of a table with several splits."""

    path: str
    schema: str | None = None
    split: str | None = None


class Registry:
    """Tables by key under one root. The root is a parameter, else SPARKVANE_DATA."""

    def __init__(self, tables: dict[str, TableSpec], root: str | None = None):
        self.tables, self.root = tables, root or os.environ.get("SPARKVANE_DATA", "")

    def scan(self, spark: SparkSession, key: str, split: str | None = None) -> DataFrame:
        spec = self.tables[key]
        df = spark.read.parquet(f"{self.root}/{spec.path}")
        df = df.where(F.col(spec.split) == split) if split and spec.split else df
        return conformed(df, spec.schema) if spec.schema else df

    def optional(self, spark: SparkSession, key: str) -> DataFrame:
        """The table, or an empty one of its schema where it can't be found; only that failure is caught."""
        try:
            return self.scan(spark, key)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], self.tables[key].schema)

    def counts(self, spark: SparkSession, only: str | None = None) -> DataFrame:
        """table, split, n: rows of one table or all, by split where there are splits."""
        out = None
        for key in [only] if only else sorted(self.tables):
            split = self.tables[key].split
            df = self.scan(spark, key)
            n = (df.groupBy(F.col(split).alias("split")) if split else df.groupBy(F.lit("all").alias("split"))).agg(F.count("*").alias("n"))
            n = n.select(F.lit(key).alias("table_name"), "split", "n")
            out = n if out is None else out.unionByName(n)
        return out


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns and types of a schema; `ordinal`, if there is one, stays.

    A scalar where a list is wanted becomes a list of it, anything but text where text is wanted is
    written as Python's str() does, and a missing column is null.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in T.StructType.fromDDL(schema).fields:
        kind, x = have.get(f.name), F.col(f.name) if f.name in have else F.lit(None)
        if kind is None or isinstance(kind, T.NullType):
            x = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(kind, T.ArrayType):
            x = F.when(x.isNotNull(), F.array(rendered(x, kind))).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            x = rendered(x, kind)
        elif kind != f.dataType:
            x = x.cast(f.dataType)
        out.append(x.alias(f.name))
    return df.select(*out, *[c for c in ("ordinal",) if c in have])


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where its files give fewer tasks than that: a table of one row group is one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def keyed(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row of each key: the content of the last row, at the place of the first."""
    mine = Window.partitionBy(key)
    last = F.row_number().over(mine.orderBy(F.col(ordinal).desc()))
    return df.withColumns({"__last": last, "__place": F.min(ordinal).over(mine)}).where("__last = 1").withColumn(ordinal, F.col("__place")).drop("__last", "__place")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> int:
    """One file with one list, non-ASCII kept; rows come to the driver a partition at a time. The result, not the corpus."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.orderBy(*order).toLocalIterator():
            f.write((", " if n else "") + json.dumps(row.asDict(recursive=True), ensure_ascii=False))
            n += 1
        f.write("]")
    return n


def read_json_array(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_raw_array(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, raw: every element of a file's list as JSON text; an error if it is no list."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, list):
        raise ValueError("the file must hold a list")
    return spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(data)], "ordinal long, raw string")


def write_zip(json_path: str, zip_path: str) -> list[str]:
    """A zip of the one member prediction.json; an older file is replaced. The members' names."""
    if os.path.exists(zip_path):
        os.remove(zip_path)
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(json_path, "prediction.json")
    with zipfile.ZipFile(zip_path) as z:
        return z.namelist()


def write_archive(folder: str, zip_path: str) -> list[str]:
    """A zip of all files below a folder of the driver, named from the folder on; the members' names."""
    top = os.path.basename(os.path.abspath(folder))
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                z.write(os.path.join(at, name), os.path.join(top, os.path.relpath(os.path.join(at, name), folder)))
        return z.namelist()


def preview(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """The first row, its texts cut to so many characters."""
    return df.limit(1).select(*[F.substring(c, 1, lengths[c]).alias(c) if c in lengths else F.col(c) for c in df.columns])
