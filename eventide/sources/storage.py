"""Tables stored by key and in order, so that scans, windows and joins by that key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from eventide.sources.work import shared_dir


class Bucketed:
    """df as a table dealt to `buckets` by keys and sorted within by keys and order; a file a bucket, written in one shuffle.

    Reads, windows and aggregates by the keys, and joins with a table bucketed alike, have no exchange. A key's rows are one bucket's, as they would be one task's in any window
    by it, so buckets are sized by rows: as many as make some `rows_each` of them, rounded up to a power of two, so that tables of different sizes can meet (the larger number of buckets is a multiple).
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str] = (), *, buckets: int | None = None, rows_each: int = 4_000_000):
        self.spark = df.sparkSession
        if buckets is None:
            each = -(-df.count() // rows_each)
            buckets = max(8, 1 << max(0, each - 1).bit_length())
        self.name, self.at, self.buckets = f"eventide_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/eventide-{uuid.uuid4().hex}", buckets
        writer = df.repartition(buckets, *keys).write.format("parquet").option("path", self.at).bucketBy(buckets, *keys).sortBy(*keys, *order)
        writer.saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        if self.spark.sparkContext._jsc is None or self.spark.sparkContext._jsc.sc().isStopped():
            return
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exchanges(df: DataFrame) -> list[str]:
    """The exchanges of the physical plan, as its lines say them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*()0123456789") for line in plan.splitlines() if "Exchange" in line]
