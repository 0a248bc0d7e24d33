"""Studies as a table: an axis of specs and layers in one plan, with the verdict ladder as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.normal import normal_quantile
from eventide.operators import returns as R
from eventide.operators import study as E
from eventide.operators.verdicts import FAMILY_ALPHA, SAMPLE_GATE
from eventide.sources.readers import last_day_upto

ALL = "all"
SIG, NOT_SIG, INSUFFICIENT, AMBIGUOUS = "SIG", "NOT_SIG", "INSUFFICIENT", "AMBIGUOUS"


def known(x: Column) -> Column:
    """x, with NaN as NULL: a statistic that isn't there is never an insignificant one."""
    return F.when(~F.isnan(x), x)


def side(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0))


def verdict(n_valid: Column, adj_bmp: Column, naive: Column, rank: Column, calendar: Column, alpha: Column, *, policy: str = "three_method") -> Column:
    """The ladder as a column; the first rung that holds."""
    if policy not in ("three_method", "adj_bmp_main_only"):
        raise ValueError(f"unknown policy {policy!r}")
    adj, naive, rank, calendar = known(adj_bmp), known(naive), known(rank), known(calendar)
    critical = normal_quantile(1 - alpha / 2)
    passes = F.when(F.abs(adj) > critical, SIG).otherwise(NOT_SIG)
    out = F.when(n_valid < SAMPLE_GATE, INSUFFICIENT).when(adj.isNull(), AMBIGUOUS)
    if policy == "adj_bmp_main_only":
        return out.otherwise(passes)
    way = side(adj)
    return (
        out.when((F.coalesce(F.abs(naive), F.lit(0.0)) > critical) & (F.abs(adj) <= critical), NOT_SIG)  # clustering makes the naive test reject too often
        .when(side(calendar) * way < 0, AMBIGUOUS)
        .when((way != 0) & (side(rank) == way) & (side(calendar) == way), passes)
        .otherwise(AMBIGUOUS)
    )


def alignment(outcome: Column, stat: Column) -> Column:
    """Where the authoritative statistic points; no direction where there is no verdict."""
    stat = known(stat)
    return F.when(outcome.isin(INSUFFICIENT, AMBIGUOUS) | stat.isNull(), "UNAVAILABLE").when(stat > 0, "ALIGNED").when(stat < 0, "REVERSED").otherwise("NEUTRAL")


def benchmark_of(spec: E.Spec) -> str:
    return spec.benchmark if spec.members is None else f"{spec.benchmark}:{','.join(sorted(spec.members))}"


def markets(returns: DataFrame, bars: DataFrame, calendar: DataFrame, specs: list[E.Spec]) -> DataFrame:
    """(benchmark, cal_idx, rm) of every benchmark that a spec names, from one pass over the returns."""
    names = {benchmark_of(s): s for s in specs}
    rows = returns.filter("ret is not null")
    if "pool_pit" in names:
        rows = rows.join(R.pool(bars, calendar).select("d", "sec", F.lit(True).alias("_in")), ["d", "sec"], "left")
    member = {"market": F.lit(True), "pool_pit": F.col("_in"), "pool": None}
    marks = [F.when(F.col("sec").isin(*s.members) if s.members is not None else member[s.benchmark], F.lit(name)) for name, s in names.items()]
    return rows.select("cal_idx", "ret", F.explode(F.array_compact(F.array(*marks))).alias("benchmark")).groupBy("benchmark", "cal_idx").agg(F.avg("ret").alias("rm"))


def studies(
    bars: DataFrame, calendar: DataFrame, events: DataFrame, specs: list[E.Spec], keep: Callable[[DataFrame], DataFrame], *, group: Column, trials: int | None = None, st: DataFrame | None = None
) -> DataFrame:
    """A row for each spec and layer (and `all`): counts, the whole suite of tests of the main window, both verdicts and the alignment.

    bars, calendar and events as in Study. Specs that differ in length or coverage only share their cleaning, model and abnormal returns; those that share a
    policy share the cleaning. Bars are read once, returns are computed once, and every statistic of all specs is one grouped aggregate. group: what events correlate
    within. trials: the size of the family, by which the level is divided (the specs by default). A correction without a value leaves the
    verdict ambiguous. A layer that no event survives keeps its row, and its status says why.
    """
    ids = [s.digest[:12] for s in specs]
    if not specs or len(set(ids)) < len(ids):
        raise ValueError("specs must be there and differ")
    cal = keep(calendar)
    bars = keep(bars)
    flat = (F.col("open") == F.col("close")) & (F.col("high") == F.col("low"))
    marked = bars.join(F.broadcast(cal), "d").withColumn("one_word", flat)
    returns = keep(R.gap_returns(bars).join(F.broadcast(cal), "d"))
    market = keep(markets(returns, bars, cal, specs))

    at = keep(last_day_upto(events, cal, "anchor").withColumnRenamed("cal_idx", "anchor_idx"))
    rules = dict.fromkeys((s.policy, s.tau0_on_anchor) for s in specs)
    cleaned = None
    for policy, on_anchor in rules:  # a handful: each is another ladder
        one = E.clean(at, marked, cal, policy=policy, st=st, tau0_on_anchor=on_anchor).withColumns({"policy": F.lit(policy), "on_anchor": F.lit(on_anchor)})
        cleaned = one if cleaned is None else cleaned.unionByName(one)

    # an event once for each model: what its returns are compared with, and the rule that places it
    models = dict.fromkeys((s.policy, s.tau0_on_anchor, benchmark_of(s)) for s in specs)
    rows = spread(cleaned, "policy string, on_anchor boolean, benchmark string", list(models), ["policy", "on_anchor"])
    rows = keep(rows.withColumns({"own_id": F.col("event_id"), "event_id": F.concat_ws("|", "policy", F.col("on_anchor").cast("string"), "benchmark", "event_id")}))
    open_ = rows.filter("reject_reason is null")
    est = keep(E.estimation(open_, returns, market))
    fit = keep(E.market_model(open_, est, market))

    # and once for each spec of the model
    axis = [(i, s.policy, s.tau0_on_anchor, benchmark_of(s), s.length, s.min_obs) for i, s in zip(ids, specs)]
    by_spec = spread(rows, "spec string, policy string, on_anchor boolean, benchmark string, length int, min_obs int", axis, ["policy", "on_anchor", "benchmark"])
    final = keep(E.survivors(by_spec, fit, length=F.col("length"), min_obs=F.col("min_obs")).withColumns({"grp": group, "lay": F.array(F.lit(ALL), F.coalesce("layer", F.lit("none")))}))
    kept = final.filter("reject_reason is null").select("spec", "event_id", "length", "grp", "lay")

    events_in = final.filter("reject_reason is null").drop("spec", "length", "min_obs", "lay", "grp").dropDuplicates(["event_id"])
    ab = E.abnormal(events_in, returns, market, length=max(s.length for s in specs))
    days = keep(ab.select("event_id", "tau", "cal_idx", "anchor_idx", "ar", "sar").join(kept, "event_id").filter("tau < length"))

    layer = F.explode("lay").alias("layer")
    keys = ["spec", "layer"]
    cars = days.groupBy("spec", "event_id", "length").agg(F.sum("ar").alias("car"), F.sum("sar").alias("csar"), F.count("ar").alias("k"), F.first("lay").alias("lay")).filter("k = length")
    tests = cars.select("spec", "car", "csar", layer).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("car").alias("mean_car"), E.t_of("car").alias("naive_t"), E.t_of("csar").alias("bmp_car"))

    groups = kept.select("event_id", "spec", "grp", layer).select("event_id", F.to_json(F.array("spec", "layer", F.coalesce("grp", F.lit("")))).alias("grp"))
    said = F.from_json("grp", "array<string>")
    sums = E.rho_sums(est, fit, groups).groupBy(said[0].alias("spec"), said[1].alias("layer")).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("rho"), F.sum("n").alias("n_pairs"))

    out = final.select("spec", "reject_reason", layer).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("reject_reason").isNull()).alias("n_valid"),
        F.coalesce(F.bool_and(F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason").isin("coverage", "history"))), F.lit(True)).alias("_thin"),
    )
    for part in (tests, sums, rank_tests(est, fit, days, kept), calendar_tests(days)):
        out = out.join(part, keys, "left")
    axis_df = out.sparkSession.createDataFrame([(i, s.length, benchmark_of(s), s.policy) for i, s in zip(ids, specs)], "spec string, length int, benchmark string, policy string")
    out = out.join(F.broadcast(axis_df), "spec").withColumns({"n": F.coalesce("n", F.lit(0)), "n_pairs": F.coalesce("n_pairs", F.lit(0)), "alpha": F.lit(FAMILY_ALPHA / (trials or len(specs)))})
    factor = E.kp_factor(F.coalesce("rho", F.lit(0.0)), F.col("n"), strict=False)
    out = out.withColumn("adj_bmp", F.when(F.col("bmp_car").isNotNull(), F.col("bmp_car") * factor))
    args = [F.col(c) for c in ("n_valid", "adj_bmp", "naive_t", "rank_t", "calendar_t", "alpha")]
    out = out.withColumns({"verdict": verdict(*args), "main_only": verdict(*args, policy="adj_bmp_main_only")}).withColumn("effect", alignment(F.col("main_only"), F.col("adj_bmp")))
    status = F.when(F.col("n_valid") > 0, "TESTED").when(F.col("_thin"), "UNESTIMABLE_BY_FROZEN_COVERAGE").otherwise("UNESTIMABLE_AFTER_FROZEN_CLEANING")
    return out.withColumn("status", status).select(
        "spec", "length", "benchmark", "policy", "layer", "n_events", "n_valid", "n", "mean_car", "naive_t", "bmp_car", "rho", "n_pairs", "adj_bmp", "rank_t", "calendar_t", "alpha", "verdict", "main_only", "effect", "status"
    )


def spread(rows: DataFrame, schema: str, axis: list[tuple], on: list[str]) -> DataFrame:
    """rows, each once for every entry of a short list that agrees with it in `on`."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(axis, schema)), on)


def rank_tests(est: DataFrame, fit: DataFrame, days: DataFrame, kept: DataFrame) -> DataFrame:
    """(spec, layer, rank_t): each event's returns ranked over its estimation days and its window, then the mean of each position."""
    anchor = days.select("event_id", "anchor_idx").distinct()
    rest = F.col("r") - F.col("alpha") - F.col("beta") * F.col("rm")
    before = est.join(fit.select("event_id", "alpha", "beta"), "event_id").join(anchor, "event_id").select("event_id", (F.col("cal_idx") - F.col("anchor_idx") + E.EST_TO - 1).alias("pos"), rest.alias("ar"))
    before = before.join(kept.select("spec", "event_id", "length", "lay"), "event_id")
    rows = before.unionByName(days.select("spec", "event_id", "length", "lay", F.col("tau").alias("pos"), "ar")).filter("ar is not null")
    by = Window.partitionBy("spec", "event_id")
    rank = F.rank().over(by.orderBy("ar")) + (F.count(F.lit(1)).over(Window.partitionBy("spec", "event_id", "ar")) - 1) / F.lit(2.0)
    k = rows.select("spec", "length", "lay", "pos", (rank / (F.count(F.lit(1)).over(by) + 1) - 0.5).alias("k"))
    means = k.select("spec", "length", "pos", "k", F.explode("lay").alias("layer")).groupBy("spec", "layer", "length", "pos").agg(F.avg("k").alias("k"))
    inside = F.col("pos") >= 0
    sums = means.groupBy("spec", "layer", "length").agg(F.sqrt(F.avg(F.col("k") * F.col("k"))).alias("s"), F.sum(F.when(inside, F.col("k"))).alias("total"), F.count_if(inside).alias("n"))
    return sums.select("spec", "layer", F.when((F.col("n") == F.col("length")) & (F.col("s") > 0), F.col("total") / (F.col("s") * F.sqrt(F.col("length").cast("double")))).alias("rank_t"))


def calendar_tests(days: DataFrame) -> DataFrame:
    """(spec, layer, calendar_t): the mean of each calendar day in windows, and its t over days."""
    means = days.filter("ar is not null").select("spec", "cal_idx", "ar", F.explode("lay").alias("layer")).groupBy("spec", "layer", "cal_idx").agg(F.avg("ar").alias("p"))
    return means.groupBy("spec", "layer").agg(E.t_of("p").alias("calendar_t"))
