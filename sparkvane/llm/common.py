"""Reading, shared-folder tables and small expressions used by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows (of some tens of bytes) that are broadcast at most; beyond, joins shuffle.
SMALL = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table; one whose files give fewer tasks than there are cores, as one row group does, is dealt out first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't: __name, with as many _ at its end as that takes. Spark's names don't tell cases apart."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, *without: str) -> list[Column]:
    """df's columns, whatever characters their names have, but for those named in lower case."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in without]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (found := spark.conf.get("sparkvane.shared.dir", None)):
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("sparkvane.shared.dir", found)
    return found


#: Folders of the tables written by this process, in order.
_MADE: list[str] = []


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of `by`: its lineage ends there and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    return list(_MADE)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


#: Parts that the rows of a join's key are dealt out to, where it may hold any share of them.
SALTS = 16


def met(rows: DataFrame, found: DataFrame, keys: list[str], salt: Column, how: str = "left", small: int = SMALL) -> DataFrame:
    """rows joined with found, a written table that has one row at most for each value of the keys.

    It is broadcast if it has no more rows than `small`; else its rows are repeated for each salt, so that no key's rows meet in one task.
    """
    to = found.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    if found.count() <= small:
        return rows.join(F.broadcast(to), on, how).drop(*[f"__{k}" for k in keys])
    to = to.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__t", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(to, [*on, F.col("__t") == F.col("__s")], how).drop("__s", "__t", *[f"__{k}" for k in keys])


def given_id(name: str) -> list[Column]:
    """The columns that bring an id to pandas whole: beside a null, numbers would turn into floating-point ones."""
    return [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name), F.isnull(name).alias(f"no_{name}")]


def with_nulls(ids, no_id):
    """Ids that came as by given_id, for a frame that goes back to Spark."""
    import numpy as np
    import pandas as pd

    return pd.arrays.IntegerArray(np.array(ids, np.int64), np.array(no_id, bool))


def freed() -> None:
    """Hands memory that isn't used any more back to the system, where the C library can; else it stays with the process."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str, few: bool = False) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys that come before, and the row itself.

    The order is (bucket, *order). A key may hold any share of the rows: rows are summed within
    (keys, bucket), the buckets' sums are accumulated, and the two are added. few: there are no more
    than SMALL pairs of key and bucket, so that their sums are broadcast and rows move once.
    """
    inside, before_, b_ = fresh(df, "inside"), fresh(df, "before"), fresh(df, "bucket")
    names = [fresh(df, f"key{i}") for i in range(len(keys))]
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias(b_))
    before = F.sum(b_).over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(bucket).alias(b_), F.coalesce(before, F.lit(0)).alias(before_))
    total = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col(bucket).eqNullSafe(F.col(b_))
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    joined = df.withColumn(inside, total).join(F.broadcast(sums) if few else sums, same, "left")
    return joined.withColumn(out, F.col(inside) + F.col(before_)).drop(inside, before_, b_, *names)
