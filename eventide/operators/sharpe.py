"""Sharpe ratios of many trials as data: probabilistic and deflated ratios of whole families in one grouped plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.normal import normal_cdf, normal_quantile

EULER = 0.5772156649015329
MODES = ("proxy", "trial_var", "given")


def trial_moments(returns: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, n, sharpe, skew, kurt) of each trial: Sharpe ratio with ddof 1, population skewness and kurtosis (3 for a normal).

    Sharpe is NULL for fewer than two returns or none that differ, the others for fewer than three.
    """
    sd, n = F.stddev_samp(x), F.count(x)
    return returns.groupBy(*keys).agg(
        n.alias("n"), F.when(sd > 0, F.avg(x) / sd).alias("sharpe"), F.when((n >= 3) & (sd > 0), F.skewness(x)).alias("skew"), F.when((n >= 3) & (sd > 0), F.kurtosis(x) + 3).alias("kurt")
    )


def spread(sharpe: Column, skew: Column, kurt: Column) -> Column:
    return 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe


def probabilistic_sharpe(n: Column, sharpe: Column, skew: Column, kurt: Column, benchmark: Column) -> Column:
    """The probability that the true ratio is above the benchmark; NULL for fewer than two returns or a spread that isn't positive."""
    s = spread(sharpe, skew, kurt)
    return normal_cdf(F.when((n >= 2) & (s > 0), (sharpe - benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(s)))


def expected_best_sharpe(variance: Column, trials: Column) -> Column:
    """The expected largest ratio of independent trials without skill; 0 for a single trial or no variance, NULL if the variance is."""
    some = F.greatest(trials, F.lit(2)).cast("double")
    best = F.sqrt(F.greatest(variance, F.lit(0.0))) * ((1 - EULER) * normal_quantile(1 - 1 / some) + EULER * normal_quantile(1 - 1 / (some * math.e)))
    return F.when(variance.isNull(), F.lit(None).cast("double")).when((trials < 2) | (variance <= 0), 0.0).otherwise(best)


def deflated_sharpe(trials: DataFrame, family: list[str], *, given: Column | None = None) -> DataFrame:
    """Adds to each trial (family, n, sharpe, skew, kurt) a row for each mode: trials, mode, v, sr_star, psr, dsr.

    v is the variance between trials: 'proxy', the sampling variance of the trial's own ratio; 'trial_var', the population variance of the family's ratios (NULL for fewer
    than two); 'given', the column given (no such rows without it). Trials of a family are counted by a window over trials, which are as many as strategies, not returns.
    """
    by = Window.partitionBy(*family)
    n, sr, skew, kurt = (F.col(c) for c in ("n", "sharpe", "skew", "kurt"))
    defined = sr.isNotNull() & skew.isNotNull()
    variances = {"proxy": F.when(defined & (n >= 2), spread(sr, skew, kurt) / (n - 1)), "trial_var": F.when(F.col("_known") >= 2, F.col("_var")), "given": given}
    rows = trials.withColumns({"trials": F.count(F.lit(1)).over(by), "_known": F.count("sharpe").over(by), "_var": F.var_pop("sharpe").over(by)})
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.when(defined, v.cast("double")).alias("v")) for m, v in variances.items() if v is not None))
    rows = rows.select(*trials.columns, "trials", F.inline(modes)).withColumn("sr_star", F.when(defined, expected_best_sharpe(F.col("v"), F.col("trials"))))
    return rows.withColumns({"psr": probabilistic_sharpe(n, sr, skew, kurt, F.lit(0.0)), "dsr": probabilistic_sharpe(n, sr, skew, kurt, F.col("sr_star"))})
