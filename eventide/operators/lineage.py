"""What batches were made from, over any number of levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]


def closure(parents: DataFrame, keep: Keep, *, most_levels: int = 64) -> DataFrame:
    """(child, ancestor, level): every batch that a batch was made from, with the shortest way; a batch on a cycle is its own ancestor.

    parents: (child, parent). Ways of one length, a power of two, are put behind all shorter ones, so levels double; there are fewer of them each round, and none or nothing new ends it. What a round
    finds is written (`keep`), so plans don't grow. A lineage deeper than most_levels fails.
    """
    step = _edges(parents).withColumnRenamed("parent", "ancestor")
    known = keep(step.withColumn("level", F.lit(1)))
    step, n, length = known.drop("level"), known.count(), 1
    while True:
        length *= 2
        step = keep(_then(step, step).distinct())
        if step.isEmpty():
            return known
        ways = step.withColumn("level", F.lit(length)).unionByName(_then(known, step).withColumn("level", F.col("level") + length))
        known = keep(known.unionByName(ways).groupBy("child", "ancestor").agg(F.min("level").alias("level")))
        last, (n, deepest) = n, known.agg(F.count("*"), F.max("level")).first()
        if n == last:
            return known
        if deepest > most_levels:
            raise ValueError(f"lineage is deeper than {most_levels} levels")


def _edges(parents: DataFrame) -> DataFrame:
    return parents.filter("child is not null and parent is not null").select("child", "parent").distinct()


def _then(ways: DataFrame, step: DataFrame) -> DataFrame:
    """The ways with each step from where they end behind them."""
    return ways.join(step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_next")), "ancestor").drop("ancestor").withColumnRenamed("_next", "ancestor")


def unpinned(batches: DataFrame, parents: DataFrame, pinned: DataFrame, keep: Keep) -> DataFrame:
    """(batch, n_ancestors, n_outside, first_outside, cyclic) of each batch whose lineage holds a batch that the manifest doesn't pin, or a cycle.

    batches, pinned: (batch). A parent that isn't a batch at all is outside too. Ways are followed (`closure`) between batches that others were made from; all other batches, which are most of them,
    take their parents' ancestors in one join, and their pairs are counted without being written.
    """
    edges = keep(_edges(parents))
    made_from = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    inside = pinned.select(F.col("batch").alias("ancestor")).distinct().withColumn("_in", F.lit(True))
    above = closure(made_from, keep).select(F.col("child").alias("parent"), "ancestor").join(inside, "ancestor", "left")
    own = edges.join(inside.withColumnRenamed("ancestor", "parent"), "parent", "left")
    found = own.select("child", F.col("parent").alias("ancestor"), "_in").unionByName(edges.join(above, "parent").select("child", "ancestor", "_in"))
    # one exchange serves both groupings
    by = found.repartition("child").distinct().groupBy(F.col("child").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_ancestors"), F.count_if(F.col("_in").isNull()).alias("n_outside"), F.min(F.when(F.col("_in").isNull(), F.col("ancestor"))).alias("first_outside"),
        F.bool_or(F.col("child") == F.col("ancestor")).alias("cyclic"),
    )
    return batches.select("batch").distinct().join(by, "batch").filter("n_outside > 0 or cyclic")
