"""Return windows, trailing windows, liquidity pools and equal-weight benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_sec():
    """A security's bars in order."""
    return Window.partitionBy("sec").orderBy("d")


def log_ratio(a: str | Column, b: str | Column) -> Column:
    return F.ln(F.col(a).cast("double") if isinstance(a, str) else a) - F.ln(F.col(b).cast("double") if isinstance(b, str) else b)


def gap_returns(bars: DataFrame) -> DataFrame:
    """The log return from the previous bar, however far back, placed on the recovery day."""
    return bars.withColumn("prev", F.lag("close").over(by_sec())).withColumn("ret", log_ratio("close", "prev")).drop("prev")


def open_gap_returns(bars: DataFrame) -> DataFrame:
    """The log return of opens to the next bar, placed where the gap starts."""
    return bars.withColumn("next", F.lead("open").over(by_sec())).withColumn("ret", log_ratio("next", "open")).drop("next")


def single_day_returns(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A return only where the bar of the open day before is there."""
    w = Window.partitionBy("sec").orderBy("cal_idx")
    rows = bars.join(F.broadcast(calendar), "d").withColumns({"prev": F.lag("close").over(w), "before": F.lag("cal_idx").over(w)})
    return rows.withColumn("ret", F.when(F.col("before") == F.col("cal_idx") - 1, log_ratio("close", "prev"))).drop("prev", "before")


def market_return(returns: DataFrame) -> DataFrame:
    """Per day the mean of the returns that arrive on it, and how many."""
    return returns.filter("ret is not null").groupBy("d").agg(F.avg("ret").alias("ret_eqw"), F.count("*").alias("n_stocks"))


def dense(bars: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Every security on every open day since its first bar; the columns are NULL where it has no bar."""
    first = bars.groupBy("sec").agg(F.min("d").alias("list_d"))
    axis = first.join(F.broadcast(calendar), F.col("d") >= F.col("list_d"))
    return axis.join(bars.select("sec", "d", *columns), ["sec", "d"], "left")


def liquidity(bars: DataFrame, calendar: DataFrame, *, days: int = 20) -> DataFrame:
    """The trailing mean of the amounts there are, and the open days since listing."""
    w = Window.partitionBy("sec").orderBy("cal_idx")
    rows = dense(bars, calendar, ["amount"])
    return rows.withColumn("trail", F.avg(F.col("amount").cast("double")).over(w.rowsBetween(1 - days, 0))).withColumn("listed", F.row_number().over(w))


def pool(bars: DataFrame, calendar: DataFrame, *, days: int = 20, least_listed: int = 120, share: float = 0.2) -> DataFrame:
    """Of the securities listed long enough with a trailing mean, each day's top share by it (ties by code)."""
    rows = liquidity(bars, calendar, days=days).filter((F.col("listed") >= least_listed) & F.col("trail").isNotNull())
    day = Window.partitionBy("d")
    ranked = rows.withColumn("rank", F.row_number().over(day.orderBy(F.desc("trail"), "sec"))).withColumn("n", F.count("*").over(day))
    return ranked.filter(F.col("rank") <= F.ceil(F.lit(share) * F.col("n"))).select("d", "sec", "trail", "rank")


def pool_return(returns: DataFrame, members: DataFrame) -> DataFrame:
    """The market return over (security, arrival day) pairs of the pool."""
    return market_return(returns.join(members.select("d", "sec"), ["d", "sec"], "left_semi")).withColumnsRenamed({"ret_eqw": "ret_pool_eqw", "n_stocks": "n_pool_stocks"})


def moving(bars: DataFrame) -> DataFrame:
    """The 60-bar high, the 10- and 20-bar means (NULL before they are full), the new-high mark."""
    n = F.row_number().over(by_sec())
    trail = lambda k: by_sec().rowsBetween(1 - k, 0)
    return bars.select(
        "*", n.alias("own_idx"),
        F.when(n >= 60, F.max("close").over(trail(60))).alias("high60"),
        F.when(n >= 10, F.sum("close").over(trail(10)).cast("decimal(24,4)")).alias("sum10"),
        F.when(n >= 20, F.sum("close").over(trail(20)).cast("decimal(24,4)")).alias("sum20"),
        F.when(n > 250, F.col("close") > F.max("close").over(by_sec().rowsBetween(-250, -1))).alias("new_high"),
    )


def prior_mean(bars: DataFrame, *, days: int = 60) -> DataFrame:
    """The mean amount of the bars before, over rows with an amount above zero."""
    w = by_sec().rowsBetween(-days, -1)
    rows = bars.filter("amount > 0")
    return rows.withColumn("ma", F.when(F.count("*").over(w) == days, F.sum("amount").over(w).cast("double") / days))


def islands(rows: DataFrame, flag: Column, order: str = "own_idx") -> DataFrame:
    """Maximal runs of flagged rows in a security's own order, with their ends and lengths."""
    w = Window.partitionBy("sec").orderBy(order)
    marked = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    runs = marked.withColumn("run", F.sum(F.when(~F.col("flag"), 1).otherwise(0)).over(w)).filter("flag")
    return runs.groupBy("sec", "run").agg(F.min("d").alias("run_start"), F.max("d").alias("run_end"), F.count("*").alias("run_len"), F.min("cal_idx").alias("i0"), F.max("cal_idx").alias("i1"))


def average_rank(rows: DataFrame, part: list[str], value: str) -> Column:
    """1-based ranks with ties averaged."""
    by = Window.partitionBy(*part)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / F.lit(2.0)
