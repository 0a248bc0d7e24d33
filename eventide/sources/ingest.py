"""Ingest that can be broken off and resumed: a file stream whose keys occur once over all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.sources.landing import Landing


def ingest(spark: SparkSession, folder: str, schema: StructType, key: list[str], table: str, checkpoint: str, *, files_each: int | None = None) -> list[int]:
    """Land what has come to a folder of JSON lines since the last run; returns the ids of the new batches.

    The checkpoint says which files are done, and its state how often each key has come: a key that comes again, in one file, in another or in a later run, fails the
    run on the executor, and so does a line that doesn't parse or a key that is NULL. What fails isn't landed, and the next run takes it up again. A batch is the stream's own: if a run dies between landing
    and its checkpoint, the next one finds the batch there and lands nothing twice. The state is kept by key, dealt like any aggregation, in the state store that
    the session names (a disk-backed one for more keys than fit in memory).
    """
    from eventide.operators.gates import require

    stream = spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_each or 1_000_000).json(folder)
    counted = stream.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*schema.names)).alias("_row"))
    target, before = Landing(spark, table), []

    def land(batch: DataFrame, epoch: int) -> None:
        if epoch in target.ids():
            batch.write.format("noop").mode("overwrite").save()  # what is kept by key must be brought up to here all the same
            return
        target.recover(epoch)  # one run at a time holds the checkpoint, so a claim is a dead run's
        ok = F.col("_n") == 1
        for k in key:
            ok = ok & F.col(k).isNotNull()
        target.land(require(batch, ok, "a key that has come before, or none", *key, "_n").select("_row.*"), epoch)
        before.append(epoch)

    query = counted.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return before
