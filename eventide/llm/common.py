"""What the operators share: tables, written intermediates, Arrow batches, 64-bit mixing."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.registry import own
from eventide.sources.work import Written, delete

#: Bytes of text that one Arrow batch from the JVM holds at most (one longer row still travels whole).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach Python small, whatever the rows' lengths. It is a setting of the session: later Arrow jobs of it have small batches too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor loses nothing. It stays until dropped(), or the end of the process."""
    table = Written(df, compression="zstd")
    own(partial(delete, table.spark, table.at))  # by name: the driver holds no plan and no list of files of tables that nothing reads any more
    return table.df


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more rows than this is split over several tasks.
HOT_ROWS, MOST_HOT = 10_000, 100_000


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], counts: DataFrame, *, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """An inner join of rows with side on keys, in which no key lands in one task.

    counts: (keys, n), how many of the `total` rows have each key. Keys with more than max(hot_rows, total / 100,000)
    rows, of which there are 100,000 at most, are split into parts of that size; their side is repeated for each part.
    """
    least = max(hot_rows, total // MOST_HOT)
    if total <= least:  # then no key has more: a plan without broadcasts
        return rows.join(side, keys)
    hot = F.broadcast(counts.filter(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts")))
    others = [c for c in rows.columns if c not in keys]
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*others), parts).cast("int")).drop("_parts")
    right = side.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def held_out(col: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id counts as held out, so it never trains."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(col: pa.Array, most: int = 1 << 20):
    """(start, length) runs of rows with about `most` bytes of text each, at least a row."""
    sizes = np.asarray(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    groups = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, b - a


def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
