"""Folders that driver and executors share, and documents in them that are published whole or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Only a local session may do without that setting."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkvane.scratch.dir", None)):
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("sparkvane.scratch.dir", top)
    return f"{top}/sparkvane-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, read again with its schema."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing if there is no such folder."""
    at, files = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of a file, or of the files of a table's folder; nothing if there is none."""
    at, files = _at(spark, path)
    return sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small document at path by renaming; False if there is one, which then stays. Readers see all of it or nothing."""
    at, files = _at(spark, path)
    half, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    files.mkdirs(at.getParent())
    out = files.create(half)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(half, at):
        files.delete(half, True)
        return False
    return True
