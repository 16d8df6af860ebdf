"""Session settings the engine is developed and tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "sparkvane", cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own session and none of this applies."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.files.maxPartitionBytes": "16m",
        "spark.driver.memory": os.environ.get("SPARKVANE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | extra
    return SparkSession.builder.config(map=conf).getOrCreate()
