"""Tables dealt into buckets of a key, so that joins on the key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path


class BucketedTables:
    """Tables of one job in a database of their own under the shared folder; `drop` deletes them all.

    Every table has the same number of buckets of the same key. Rows are shuffled by that key once, when
    a table is written, and each bucket is one sorted file: joins of the tables read bucket by bucket.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int | None = None):
        self.spark, self.key = spark, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"tidemark_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{scratch_path(spark, 'buckets')}'")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The stored rows of `df`, which must hold the key."""
        full = f"{self.database}.{name}"
        df.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(full)
        return self.spark.table(full)

    def joined(self, rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
        """`rows`, read from one of the tables, with the columns of the others; rows without a match get NULL.

        Merging equal buckets costs no shuffle, however large the tables are; the hint keeps small ones from being broadcast.
        """
        for t in tables:
            rows = rows.join(t.hint("merge"), self.key, "left")
        return rows

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def __enter__(self) -> BucketedTables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
