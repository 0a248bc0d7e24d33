"""The event study: cleaning ladder, market model, abnormal-return tests.

Every offset is an index of the calendar. Events meet returns by security and stretches of EST_LEN indices; no
panel is densified, and a missing row is a suspended day. run_study() puts the steps together over any bars, calendar and events.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators import returns as R
from eventide.sources.readers import last_day_upto
from eventide.sources.work import Written

#: Fixed values of the frozen configuration.
EST_FROM, EST_TO, EST_LEN, MIN_OBS, POSTPONE = 250, 91, 160, 112, 5


POLICIES = ("legacy", "unified", "unified_announcement", "missing_bar_only")


def clean(
    events: DataFrame, bars: DataFrame, calendar: DataFrame, *, policy: str = "missing_bar_only", st: DataFrame | None = None, st_policy: str = "reject", max_days: int = POSTPONE, tau0_on_anchor: bool = False
) -> DataFrame:
    """Adds tau0, is_st and reject_reason, the first that holds in the ladder's order.

    events: (event_id, sec, anchor, anchor_idx), anchor_idx the last open day up to the anchor. bars: (sec, d, cal_idx,
    one_word). st: (sec, cal_idx) of days under special treatment, or (sec) of securities that are under it throughout (st_days()); st_policy
    rejects events of these, or keeps them and marks them.
    legacy and unified need the anchor itself to be an open day; legacy rejects a suspension at T or T+1,
    unified one at T. tau0 is the first day from T+1 (or T) that isn't blocked, at most `max_days` later:
    missing bars block under every policy, one-word bars under all but missing_bar_only.
    """
    if st_policy not in ("reject", "keep"):
        raise ValueError(f"no such policy: {st_policy}")
    if policy not in POLICIES or tau0_on_anchor and policy != "missing_bar_only":
        raise ValueError(f"no such policy: {policy}, tau0_on_anchor={tau0_on_anchor}")
    have = bars.select("sec", "cal_idx")
    free = have if policy == "missing_bar_only" else bars.filter(~F.coalesce("one_word", F.lit(False))).select("sec", "cal_idx")
    listed = have.groupBy("sec").agg(F.count("*").alias("n_bars"))
    e = events
    if policy in ("legacy", "unified"):
        exact = F.broadcast(calendar.select(F.col("d").alias("anchor"), F.lit(True).alias("exact")))
        e = e.join(exact, "anchor", "left").withColumn("anchor_idx", F.when(F.col("exact"), F.col("anchor_idx"))).drop("exact")
    e = e.withColumn("start", F.col("anchor_idx") + (0 if tau0_on_anchor else 1))
    # of the days that may be tau0, the first that is free; days just around the anchor tell suspensions
    slots = e.select("event_id", "sec", "anchor_idx", "start", F.explode(F.sequence(F.col("anchor_idx"), F.col("start") + max_days)).alias("cal_idx"))
    near = slots.join(free.withColumn("free", F.lit(True)), ["sec", "cal_idx"], "left").join(have.withColumn("bar", F.lit(True)), ["sec", "cal_idx"], "left")
    found = near.groupBy("event_id").agg(
        F.min(F.when(F.col("free") & (F.col("cal_idx") >= F.col("start")), F.col("cal_idx"))).alias("tau0"),
        F.bool_or(F.col("bar").isNull() & (F.col("cal_idx") == F.col("anchor_idx"))).alias("gone0"), F.bool_or(F.col("bar").isNull() & (F.col("cal_idx") == F.col("anchor_idx") + 1)).alias("gone1"),
    )
    e = e.join(listed, "sec", "left").join(found, "event_id", "left").crossJoin(F.broadcast(calendar.agg(F.max("cal_idx").alias("last_idx"))))
    is_st = F.lit(False)
    if st is not None:
        days = st.withColumnRenamed("cal_idx", "anchor_idx").distinct().withColumn("_st", F.lit(True))
        e = e.join(days, [c for c in days.columns if c != "_st"], "left")
        is_st = F.coalesce("_st", F.lit(False))
    # a row beyond the axis is not a suspension
    gone1 = F.col("gone1") & (F.col("anchor_idx") + 1 <= F.col("last_idx"))
    day = {"legacy": F.when(F.col("gone0") | gone1, "suspension"), "unified": F.when(F.col("gone0"), "event_day_anomaly")}.get(policy, F.lit(None).cast("string"))
    ladder = (
        F.when(F.col("n_bars").isNull(), "no_price").when(F.col("anchor_idx").isNull(), "history").when(F.col("anchor_idx") < EST_FROM, "history").when(is_st & F.lit(st_policy == "reject"), "st")
    )
    last = F.when(F.col("tau0").isNull() & (F.col("start") + max_days > F.col("last_idx")), "history").when(F.col("tau0").isNull(), "postpone")
    return e.select(*events.columns, "tau0", "last_idx", is_st.alias("is_st"), F.coalesce(ladder, day, last).alias("reject_reason"))


def st_days(rows: DataFrame, mode: str = "event_day") -> DataFrame:
    """What clean() takes as st. rows: (sec, d, cal_idx, st). event_day: the days marked; legacy_row0: the securities whose first row is marked."""
    if mode == "event_day":
        return rows.filter("st").select("sec", "cal_idx")
    if mode != "legacy_row0":
        raise ValueError(f"no such mode: {mode}")
    return rows.groupBy("sec").agg(F.min_by("st", "d").alias("st")).filter("st").select("sec")


def market_keys(market: DataFrame) -> list[str]:
    """What a market's returns are keyed by besides the day: nothing for a single benchmark; else columns that the events carry too."""
    return [c for c in market.columns if c not in ("cal_idx", "rm")]


def estimation(events: DataFrame, returns: DataFrame, market: DataFrame) -> DataFrame:
    """(event_id, sec, cal_idx, r, rm): the returns of each event's estimation window, NULL market days left out of neither side.

    A window of EST_LEN indices lies in two stretches of that length, so events meet returns by (security, stretch):
    what a security did years before or after isn't read for them.
    """
    stretch = lambda i: F.floor(i / EST_LEN).cast("int")
    first, last = F.col("anchor_idx") - EST_FROM, F.col("anchor_idx") - EST_TO
    keys = market_keys(market)
    e = events.filter("anchor_idx is not null").select("event_id", "sec", *keys, first.alias("lo"), last.alias("hi"), F.explode(F.sequence(stretch(first), stretch(last))).alias("stretch"))
    r = returns.select("sec", "cal_idx", F.col("ret").alias("r"), stretch(F.col("cal_idx")).alias("stretch"))
    return e.join(r, ["sec", "stretch"]).filter("cal_idx between lo and hi").join(F.broadcast(market), [*keys, "cal_idx"]).select("event_id", "sec", "cal_idx", "r", "rm")


def axis_sums(market: DataFrame) -> DataFrame:
    """(keys, cal_idx, n, s, q): how many market returns there are up to each day, their sum and their sum of squares."""
    keys = market_keys(market)
    ends = market.filter("rm is not null").groupBy(*keys).agg(F.min("cal_idx").alias("a"), F.max("cal_idx").alias("b"))
    axis = ends.filter("a is not null").select(*keys, F.explode(F.sequence("a", "b")).alias("cal_idx"))
    w = Window.partitionBy(*keys).orderBy("cal_idx").rowsBetween(Window.unboundedPreceding, 0)  # a row per day: a bounded axis
    return axis.join(market, [*keys, "cal_idx"], "left").select(
        *keys, "cal_idx", F.count("rm").over(w).alias("n"), F.coalesce(F.sum("rm").over(w), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("rm") * F.col("rm")).over(w), F.lit(0.0)).alias("q")
    )


def market_model(events: DataFrame, est: DataFrame, market: DataFrame) -> DataFrame:
    """OLS over complete cases; x_bar and sxx over every market day of the window, traded or not, as differences of sums along the axis."""
    fit = est.filter("r is not null and rm is not null").groupBy("event_id").agg(
        F.regr_slope("r", "rm").alias("beta"), F.regr_intercept("r", "rm").alias("alpha"), F.count("*").alias("delta")
    )
    both = est.join(fit, "event_id").withColumn("e", F.col("r") - F.col("alpha") - F.col("beta") * F.col("rm"))
    sd = both.groupBy("event_id").agg(F.stddev_samp("e").alias("sd"))
    sums = axis_sums(market)
    keys = market_keys(market)
    ends = F.broadcast(sums.groupBy(*keys).agg(F.min("cal_idx").alias("first"), F.max("cal_idx").alias("last")))
    at = lambda i, name: F.broadcast(sums.select(*keys, F.col("cal_idx").alias(i), *(F.col(c).alias(f"{name}_{c}") for c in "nsq")))
    w = events.filter("anchor_idx is not null").select("event_id", "anchor_idx", *keys)
    w = w.join(ends, keys) if keys else w.crossJoin(ends)  # a row a benchmark
    w = w.select("event_id", *keys, (F.col("anchor_idx") - EST_FROM - 1).alias("before"), F.least(F.col("anchor_idx") - EST_TO, F.col("last")).alias("upto"))
    w = w.join(at("before", "a"), [*keys, "before"], "left").join(at("upto", "b"), [*keys, "upto"], "left")
    n, s, q = (F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0)) for c in "nsq")
    days = w.select("event_id", n.alias("n"), s.alias("s"), q.alias("q")).filter("n > 0").select("event_id", (F.col("s") / F.col("n")).alias("x_bar"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("sxx"))
    return fit.join(sd, "event_id").join(days, "event_id")


def survivors(cleaned: DataFrame, fit: DataFrame, *, length: int | Column, min_obs: int | Column = MIN_OBS) -> DataFrame:
    """Coverage, then the right edge; earlier reasons stay. The length and the least coverage may differ by row."""
    e = cleaned.join(fit, "event_id", "left")
    late = (
        F.when(F.coalesce("delta", F.lit(0)) < 2, "ols_error").when(F.col("delta") < min_obs, "coverage")
        .when(F.col("tau0") + length - 1 > F.col("last_idx"), "history")
    )
    return e.withColumn("reject_reason", F.coalesce("reject_reason", late))


def abnormal(events: DataFrame, returns: DataFrame, market: DataFrame, *, length: int, sign: Column | None = None) -> DataFrame:
    """(event_id, tau, ar, rm, sar) for tau 0..length-1; NULL where a day has no return. sign: E09, before everything else."""
    taus = events.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("tau")).withColumn("cal_idx", F.col("tau0") + F.col("tau"))
    x = taus.join(returns.select("sec", "cal_idx", F.col("ret").alias("r")), ["sec", "cal_idx"], "left").join(F.broadcast(market), [*market_keys(market), "cal_idx"], "left")
    ar = F.col("r") - F.col("alpha") - F.col("beta") * F.col("rm")
    scale = F.col("sd") * F.sqrt(1 + F.try_divide(F.lit(1.0), F.col("delta")) + F.try_divide((F.col("rm") - F.col("x_bar")) * (F.col("rm") - F.col("x_bar")), F.col("sxx")))
    x = x.withColumn("ar", ar * sign if sign is not None else ar)
    return x.withColumn("sar", F.when((F.col("sd") > 0) & (F.col("sxx") > 0), F.try_divide(F.col("ar"), scale)))


def t_of(x: str) -> Column:
    """mean / sd * sqrt(n); NULL for fewer than two values or none that differ."""
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.count(x).cast("double")))


def kp_factor(rho: Column, n: Column, *, strict: bool = True) -> Column:
    """The correction for cross-sectional correlation. Where it has no value (its denominator isn't positive) the job fails, or with strict=False it is NULL."""
    below = 1 + (n - 1) * rho
    why = F.concat(F.lit("no correction: the denominator is "), below.cast("string"))
    return F.when(rho.isNull() | n.isNull() | (below > 0), F.sqrt((1 - rho) / below)).otherwise(F.raise_error(why).cast("double") if strict else F.lit(None).cast("double"))


def rho_bar(est: DataFrame, fit: DataFrame, groups: DataFrame, *, least: int = 3, block: int = 1000) -> DataFrame:
    """(rho, n_pairs) over the pairs of all groups; 0 without any."""
    sums = rho_sums(est, fit, groups, least=least, block=block)
    return sums.agg(F.coalesce(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("rho"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def rho_sums(est: DataFrame, fit: DataFrame, groups: DataFrame, *, least: int = 3, block: int = 1000) -> DataFrame:
    """(grp, total, n), a few rows a group: the correlation of estimation residuals over event pairs of one group with common days.

    groups: (event_id, grp). Two windows of EST_LEN days meet only if they begin in one stretch of that length or in two that adjoin, so an
    event travels twice, as one row of residuals, and a task compares a block of events of a stretch with a block of the
    same or the next one by products of matrices. What leaves a task is a sum and a count, not pairs.
    """
    e = est.join(fit.select("event_id", "alpha", "beta"), "event_id").join(groups, "event_id")
    e = e.withColumn("ar", F.col("r") - F.col("alpha") - F.col("beta") * F.col("rm")).filter("ar is not null")
    rows = e.groupBy("grp", "event_id").agg(F.min("cal_idx").alias("first"), F.collect_list(F.struct("cal_idx", "ar")).alias("days"))  # at most EST_LEN days
    rows = rows.withColumn("stretch", F.floor(F.col("first") / EST_LEN).cast("int"))
    sizes = rows.groupBy("grp", "stretch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    following = sizes.select("grp", (F.col("stretch") - 1).alias("stretch"), F.col("blocks").alias("later"))
    before = sizes.select("grp", (F.col("stretch") + 1).alias("stretch"), F.col("blocks").alias("earlier"))
    rows = rows.join(sizes, ["grp", "stretch"]).join(following, ["grp", "stretch"], "left").join(before, ["grp", "stretch"], "left").withColumn("own", F.pmod(F.xxhash64("event_id"), F.col("blocks")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, at, lo, hi, late: F.struct(F.lit(kind).alias("kind"), at.alias("at"), lo.alias("lo"), hi.alias("hi"), late.alias("late"))
    at, own, none = F.col("stretch"), F.col("own"), F.array().cast("array<struct<kind:int,at:int,lo:int,hi:int,late:boolean>>")
    tasks = F.concat(
        F.transform(upto(F.col("blocks")), lambda j: task(0, at, F.least(own, j), F.greatest(own, j), own > j)),
        F.when(F.col("later").isNotNull(), F.transform(upto(F.col("later")), lambda j: task(1, at, own, j, F.lit(False)))).otherwise(none),
        F.when(F.col("earlier").isNotNull(), F.transform(upto(F.col("earlier")), lambda j: task(1, at - 1, j, own, F.lit(True)))).otherwise(none),
    )
    dealt = rows.select("grp", "event_id", "days", F.explode(tasks).alias("t")).select("grp", "t.kind", "t.at", "t.lo", "t.hi", "t.late", "event_id", "days")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, width = int(pdf["at"].iloc[0]) * EST_LEN, 3 * EST_LEN
        x, mask = np.zeros((len(pdf), width)), np.zeros((len(pdf), width))
        for i, days in enumerate(pdf["days"]):
            idx = np.array([d["cal_idx"] for d in days]) - begin
            x[i, idx], mask[i, idx] = [d["ar"] for d in days], 1.0
        late = pdf["late"].to_numpy(bool)
        alone = pdf["kind"].iloc[0] == 0 and pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        a, b = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(~late), np.flatnonzero(late))
        xa, xb, ma, mb = x[a], x[b], mask[a], mask[b]
        n = ma @ mb.T
        with np.errstate(all="ignore"):
            sa, sb, qa, qb = xa @ mb.T, ma @ xb.T, (xa * xa) @ mb.T, ma @ (xb * xb).T
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            rho = (xa @ xb.T - sa * sb / n) / np.sqrt(va * vb)
            good = (n >= least) & (va > 1e-12 * qa) & (vb > 1e-12 * qb)
        if alone:
            good &= np.triu(np.ones(good.shape, bool), 1)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "total": [float(rho[good].sum())], "n": [int(good.sum())]})

    return dealt.groupBy("grp", "kind", "at", "lo", "hi").applyInPandas(compare, "grp string, total double, n long")


def car(ab: DataFrame, *, length: int) -> DataFrame:
    """The sums of each event whose window is complete."""
    return ab.filter(F.col("tau") < length).groupBy("event_id").agg(F.sum("ar").alias("car"), F.sum("sar").alias("csar"), F.count("ar").alias("n"), F.count("sar").alias("m")).filter(F.col("n") == length)


def corrado(est: DataFrame, fit: DataFrame, ab: DataFrame) -> DataFrame:
    """(pos, kbar): the mean centred rank at each position, estimation days below zero, event days from it."""
    e = est.join(fit.select("event_id", "alpha", "beta"), "event_id")
    e = e.select("event_id", (F.col("cal_idx")).alias("pos"), (F.col("r") - F.col("alpha") - F.col("beta") * F.col("rm")).alias("ar"))
    anchors = ab.select("event_id", "anchor_idx").distinct()
    e = e.join(anchors, "event_id").select("event_id", (F.col("pos") - F.col("anchor_idx") + EST_TO - 1).alias("pos"), "ar")
    rows = e.unionByName(ab.select("event_id", F.col("tau").alias("pos"), "ar")).filter("ar is not null")
    by = Window.partitionBy("event_id")
    rank = F.rank().over(by.orderBy("ar")) + (F.count("*").over(Window.partitionBy("event_id", "ar")) - 1) / F.lit(2.0)
    ranked = rows.select("pos", (rank / (F.count("*").over(by) + 1) - 0.5).alias("k"))
    return ranked.groupBy("pos").agg(F.avg("k").alias("kbar"), F.count("*").alias("n"))


def corrado_windows(kb: DataFrame, lengths: list[int]) -> DataFrame:
    """(len, t): the sum of mean ranks over each window, by the scale of all positions and the root of the length; NULL if a day has no ranks."""
    scale = kb.agg(F.sqrt(F.avg(F.col("kbar") * F.col("kbar"))).alias("s"))
    days = kb.filter("pos >= 0").withColumn("len", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n > F.col("pos"))))
    sums = days.groupBy("len").agg(F.sum("kbar").alias("k"), F.count("kbar").alias("n")).crossJoin(scale)  # a single row
    return sums.select("len", F.when((F.col("n") == F.col("len")) & (F.col("s") > 0), F.col("k") / (F.col("s") * F.sqrt(F.col("len").cast("double")))).alias("t"))


def calendar_time(ab: DataFrame, *, length: int) -> DataFrame:
    """The mean abnormal return of each calendar day in windows, and its t over days."""
    days = ab.filter((F.col("tau") < length) & F.col("ar").isNotNull()).groupBy("cal_idx").agg(F.avg("ar").alias("p"))
    return days.agg(F.avg("p").alias("mean"), t_of("p").alias("t"), F.count("*").alias("n_days"))


@dataclass(frozen=True)
class Spec:
    """What a study fixes before it runs; its digest names it."""

    length: int = 20
    benchmark: str = "market"  # market, pool_pit (the day's liquidity pool) or pool (a fixed list)
    members: tuple[str, ...] | None = None
    policy: str = "missing_bar_only"
    tau0_on_anchor: bool = False
    min_obs: int = MIN_OBS

    def __post_init__(self):
        if self.benchmark not in ("market", "pool_pit", "pool") or (self.benchmark == "pool") != (self.members is not None):
            raise ValueError(f"no such benchmark: {self.benchmark}, members={self.members}")
        if self.policy not in POLICIES or self.length < 1:
            raise ValueError(f"no such study: {self}")

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Study:
    """One study over bars (sec, d, open, high, low, close, amount), a calendar (d, cal_idx) and events (event_id, sec, anchor, layer).

    What several steps read is written once; close() deletes it.
    """

    def __init__(self, bars: DataFrame, calendar: DataFrame, events: DataFrame, spec: Spec = Spec(), *, st: DataFrame | None = None):
        self.tables: list[Written] = []
        keep = self._keep
        self.spec, self.cal = spec, keep(calendar)
        bars = keep(bars)
        flat = (F.col("open") == F.col("close")) & (F.col("high") == F.col("low"))
        self.bars = bars.join(F.broadcast(self.cal), "d").withColumn("one_word", flat)
        self.returns = keep(R.gap_returns(bars).join(F.broadcast(self.cal), "d"))
        own = self.returns
        if spec.benchmark == "pool_pit":
            own = own.join(R.pool(bars, self.cal).select("d", "sec"), ["d", "sec"], "left_semi")
        elif spec.benchmark == "pool":
            own = own.filter(F.col("sec").isin(*spec.members))
        self.market = keep(own.filter("ret is not null").groupBy("cal_idx").agg(F.avg("ret").alias("rm")))
        at = last_day_upto(events, self.cal, "anchor").withColumnRenamed("cal_idx", "anchor_idx")
        self.cleaned = keep(clean(at, self.bars, self.cal, policy=spec.policy, st=st, tau0_on_anchor=spec.tau0_on_anchor))
        open_ = self.cleaned.filter("reject_reason is null")
        self.est = keep(estimation(open_, self.returns, self.market))
        self.fit = keep(market_model(open_, self.est, self.market))
        self.final = survivors(self.cleaned, self.fit, length=spec.length, min_obs=spec.min_obs)
        self.kept = self.final.filter("reject_reason is null")
        self.ab = abnormal(self.kept, self.returns, self.market, length=spec.length)

    def _keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(Written(df))
        return self.tables[-1].df

    def close(self) -> None:
        while self.tables:
            self.tables.pop().drop()

    def rho(self, group: Column) -> DataFrame:
        """(rho, n_pairs) over pairs of kept events of one group."""
        est = self.est.join(self.kept.select("event_id"), "event_id", "left_semi")
        return rho_bar(est, self.fit, self.kept.select("event_id", group.alias("grp")))

    def summary(self, group: Column) -> DataFrame:
        """One row: the CAR tests (A09, A10), the correlation (A07) and both effective sizes."""
        one = car(self.ab, length=self.spec.length).agg(F.count("*").alias("n"), t_of("csar").alias("bmp"), F.avg("car").alias("mean_car"), t_of("car").alias("naive_t"))
        x = one.crossJoin(self.rho(group))  # two single rows
        n, rho = F.col("n"), F.col("rho")
        return x.select(
            "n", F.col("bmp").alias("bmp_car"), F.when(F.col("bmp").isNotNull(), F.col("bmp") * kp_factor(rho, n)).alias("adj_bmp"), "mean_car", "naive_t", "rho", "n_pairs",
            F.when(n > 0, n / (1 + (n - 1) * rho)).alias("n_eff"), F.when(n > 0, n * (1 - rho) / (1 + (n - 1) * rho)).alias("n_eff_kp"),
        )


def run_study(bars: DataFrame, calendar: DataFrame, events: DataFrame, spec: Spec = Spec(), *, group: Column | None = None, st: DataFrame | None = None) -> DataFrame:
    """The summary of a study as one row, with the spec's digest. group: what correlates (all events by default)."""
    s = Study(bars, calendar, events, spec, st=st)
    try:
        rows = s.summary(F.lit("all") if group is None else group).withColumn("spec", F.lit(spec.digest))
        return bars.sparkSession.createDataFrame(rows.collect(), rows.schema)  # one row
    finally:
        s.close()
