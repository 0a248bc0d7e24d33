"""Checks inside a plan: what breaks a rule fails the job on the executor that meets it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventide.sources.readers import HOLDOUT


def checked(value: Column, ok: Column, message: str, *shown: str | Column) -> Column:
    """value where ok holds; else (and where ok is NULL) the job fails with the message and what is shown."""
    text = F.concat(F.lit(f"{message}: "), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})) if shown else F.lit(message)
    return F.when(ok, value).otherwise(F.raise_error(text))


def require(df: DataFrame, ok: Column, message: str, *shown: str | Column) -> DataFrame:
    """df, of which every row must meet ok. It is a filter, so no later projection prunes it."""
    return df.filter(checked(F.lit(True), ok, message, *shown))


def guard_holdout(df: DataFrame, *dates: str) -> DataFrame:
    """The second guard, behind the filters of the views: a row in the holdout, or without a date, fails the job."""
    ok = F.lit(True)
    for d in dates:
        ok = ok & (F.col(d) < F.lit(HOLDOUT).cast("date"))
    return require(df, F.coalesce(ok, F.lit(False)), "a row of the holdout", *dates)


def behind(rows: DataFrame, check: DataFrame) -> DataFrame:
    """rows, only if the single row of `check` can be computed: its checks run in the same job, before any row comes out."""
    passed = check.agg(F.max(F.xxhash64(*check.columns)).alias("_passed"))
    return rows.crossJoin(F.broadcast(passed)).filter("_passed is not null").drop("_passed")


def conserved(before: DataFrame, after: DataFrame, keys: list[str], *, outcome: str) -> DataFrame:
    """By key, how many rows came in and by which outcome they left; a key that loses or gains rows fails the job.

    Both sides are counted by key before they meet, so the join moves counts and not rows. Returns (keys, n_in, a map from outcome to count).
    """
    n_in = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = after.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("n_out"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(outcome, F.lit("?")).alias("k"), F.col("_n").alias("v"))))).alias("outcomes")
    )  # a few outcomes a key
    both = n_in.join(n_out, keys, "full")
    return require(both, F.col("n_in").eqNullSafe(F.col("n_out")), "rows are lost or gained", *keys, "n_in", "n_out").drop("n_out")


class Funnel:
    """Counts along a pipeline, taken while it runs: no pass of its own for any of them."""

    def __init__(self):
        self.stages: dict[str, Observation] = {}

    def count(self, df: DataFrame, stage: str, **of: Column) -> DataFrame:
        """df, whose rows (and those that meet a named condition) are counted when an action runs it."""
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in of.items()))

    def counts(self) -> dict[str, dict[str, int]]:
        return {stage: seen.get for stage, seen in self.stages.items()}

    def require(self, name: str, ok: bool) -> None:
        if not ok:
            raise ValueError(f"{name} doesn't hold: {self.counts()}")
