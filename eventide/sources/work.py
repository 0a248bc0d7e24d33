"""Intermediate tables: written to a folder that all executors share, read by several steps, deleted when no longer needed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master, whose driver and executors are one process, may leave it unset: a temporary folder serves then.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        at = getattr(spark, "_eventide_shared", None)
        if at is None:
            at = spark._eventide_shared = tempfile.mkdtemp(prefix="eventide-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


class Written:
    """A table in the shared folder: lineage ends there, a lost executor loses nothing, and plans that read it stay short."""

    def __init__(self, df: DataFrame, *, compression: str = "snappy"):
        self.spark, self.at = df.sparkSession, f"{shared_dir(df.sparkSession)}/eventide-{uuid.uuid4().hex}"
        # small row groups: each task that writes holds one of them
        df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(self.at)
        self.df = self.spark.read.schema(df.schema).parquet(self.at)

    def drop(self) -> None:
        delete(self.spark, self.at)


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder, unless its session is gone."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
