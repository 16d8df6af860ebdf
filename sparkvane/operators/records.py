"""Records put together from tables that are stored side by side.

Tables of one key are bucketed and sorted by it when they are written, by the same hash and into as many buckets, so that any number of
them meet bucket by bucket: the join reads them and moves nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Shelf:
    """Bucketed tables of one key in the session's catalog, to be dropped together."""

    def __init__(self, spark: SparkSession, key: str, buckets: int | None = None):
        self.spark, self.key, self.names = spark, key, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, df: DataFrame) -> DataFrame:
        """df, stored: one shuffle, and one file for each bucket. Rows without key stay in one bucket."""
        name = f"shelf_{uuid.uuid4().hex}"
        df.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def joined(self, *tables: DataFrame) -> DataFrame:
        """Stored tables joined on the key, without exchange."""
        return reduce(lambda a, b: a.join(b.hint("merge"), self.key), tables)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names = []
