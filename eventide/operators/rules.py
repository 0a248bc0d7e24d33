"""Event-selection rules as windows and joins (R04-R09, R11-R13); those with whole funnels are in selection.

Rows are in a security's own order unless a rule says calendar index. None of the rules folds over rows:
path dependence becomes running sums that number the episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def own():
    """A security's rows in order."""
    return Window.partitionBy("sec").orderBy("d")


def to_here(w=None):
    return (w or own()).rowsBetween(Window.unboundedPreceding, 0)


def high_pullback(rows: DataFrame, *, days: int = 10, touch: str = "0.97", floor: str = "0.95") -> DataFrame:
    """After a new high, the first close within `days` calendar ranks at or below touch x the high.

    rows: (sec, d, cal_idx, close, new_high, above_ma). EVENT if it is at or above floor x the high and
    above the mean, else MA_KILL or DEEP_KILL; NO_TOUCH; TRUNCATED where the axis ends first.
    """
    x = rows.withColumn("high_no", F.sum(F.coalesce(F.col("new_high"), F.lit(False)).cast("int")).over(to_here())).filter("high_no > 0")
    by = Window.partitionBy("sec", "high_no")
    x = x.withColumns({"anchor": F.min("cal_idx").over(by), "c0": F.min_by("close", "d").over(by), "anchor_d": F.min("d").over(by)})
    low = (F.col("close") <= F.col("c0") * F.lit(touch).cast("decimal(3,2)")) & (F.col("cal_idx") <= F.col("anchor") + days)
    hit = F.min(F.when(low, F.struct("d", "close", "above_ma"))).alias("hit")
    g = x.groupBy("sec", "high_no", "anchor_d", "anchor", "c0").agg(hit).crossJoin(F.broadcast(rows.agg(F.max("cal_idx").alias("last_idx"))))
    later = F.lead("anchor").over(Window.partitionBy("sec").orderBy("high_no"))
    g = g.withColumn("reset", F.col("hit").isNull() & F.coalesce(later <= F.col("anchor") + days, F.lit(False)))
    outcome = (
        F.when(F.col("hit").isNull() & F.col("reset"), "RESET").when(F.col("hit").isNull() & (F.col("anchor") + days > F.col("last_idx")), "TRUNCATED").when(F.col("hit").isNull(), "NO_TOUCH")
        .when(F.col("hit.close") < F.col("c0") * F.lit(floor).cast("decimal(3,2)"), "DEEP_KILL").when(F.col("hit.above_ma"), "EVENT").otherwise("MA_KILL")
    )
    return g.select("sec", "anchor_d", F.col("hit.d").alias("d"), outcome.alias("outcome"))


def volume_drought(rows: DataFrame, *, share: str = "0.30", least: int = 5, days: int = 60) -> DataFrame:
    """A run of `least` rows with low amounts arms; the first amount above the mean decides and resets.

    rows: (sec, d, cal_idx, open, close, amount decimal). The mean is that of the `days` eligible rows before, across suspensions; rows without amount, open or close are
    not eligible. They reset, and so does a calendar gap. Returns (sec, d, outcome, low_start, low_days): low_days counts low rows from the first armed run on.
    """
    ok = (F.coalesce(F.col("amount"), F.lit(0)) > 0) & F.col("open").isNotNull() & F.col("close").isNotNull()
    broken = ~ok | F.coalesce(F.col("cal_idx") - F.lag("cal_idx").over(own()) != 1, F.lit(True))
    x = rows.withColumn("grp", F.sum(broken.cast("int")).over(to_here())).filter(ok)
    before = own().rowsBetween(-days, -1)
    x = x.withColumns({"total": F.sum("amount").over(before), "n": F.count("*").over(before)}).filter(F.col("n") == days)
    scaled = F.col("amount") * days
    x = x.withColumns({"out": scaled > F.col("total"), "low": scaled < F.col("total") * F.lit(share).cast("decimal(4,2)")})
    by = lambda *c: Window.partitionBy("sec", "grp", *c)
    x = x.withColumn("sub", F.coalesce(F.sum(F.col("out").cast("int")).over(by().orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("isl", F.row_number().over(by("sub").orderBy("d")) - F.row_number().over(by("sub", "low").orderBy("d")))
    x = x.withColumn("run", F.count("*").over(by("sub", "low", "isl")))
    x = x.withColumn("low_start", F.min(F.when(F.col("low") & (F.col("run") >= least), F.col("d"))).over(by("sub")))
    x = x.withColumn("low_days", F.sum((F.col("low") & (F.col("d") >= F.col("low_start"))).cast("long")).over(by("sub")))
    return x.filter("out and low_start is not null").select("sec", "d", F.when(F.col("close") > F.col("open"), "event").otherwise("reject").alias("outcome"), "low_start", "low_days")


def yearend_windows(calendar: DataFrame, *, n: int = 10) -> DataFrame:
    """(year, d, place): the last n days of each December (1 to n), the day before them (0) and the first day of the next January (n + 1)."""
    axis = Window.orderBy("d")  # a bounded axis
    back = F.row_number().over(Window.partitionBy(F.year("d"), F.month("d")).orderBy(F.desc("d")))
    x = calendar.select("d", F.row_number().over(axis).alias("i"), F.when((F.month("d") == 12) & (back <= n), n + 1 - back).alias("place"), F.year("d").alias("year"))
    whole = x.filter("place is not null").groupBy("year").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last")).filter((F.col("n") == n) & (F.col("first") > 1))
    at = whole.select("year", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("i"), (F.col("i") - F.col("first") + 1).alias("place"))
    return at.join(x.select("i", "d"), "i").select("year", "d", "place")


def yearend_strength(bars: DataFrame, market: DataFrame, windows: DataFrame, *, least: float = 0.05, n: int = 10) -> DataFrame:
    """What becomes of each security and year with a bar in the window: (sec, year, event_date, excess, outcome).

    All n + 1 closes, that of the day before the window included, must be there and above zero; the security's growth over the market's is the excess.
    bars: (sec, d, close); market: (d, ret_eqw); windows: those of yearend_windows().
    """
    days = windows.filter(F.col("place") <= n)
    grown = days.filter("place > 0").join(market, "d", "left").groupBy("year").agg(F.sum("ret_eqw").alias("market"), F.count("ret_eqw").alias("days")).filter(F.col("days") == n)
    event = windows.filter(F.col("place") == n + 1).select("year", F.col("d").alias("event_date"))
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("close")))
    g = bars.join(F.broadcast(days), "d").groupBy("sec", "year").agg(F.count("close").alias("n"), F.min("close").alias("low"), at(0).alias("c0"), at(n).alias("c1"))
    g = g.join(F.broadcast(grown), "year").join(F.broadcast(event), "year").filter("n > 0")
    excess = F.exp(F.ln(F.col("c1").cast("double")) - F.ln(F.col("c0").cast("double")) - F.col("market")) - 1
    outcome = (
        F.when((F.col("n") < n + 1) & F.col("c0").isNull(), "base_missing").when(F.col("n") < n + 1, "panel_partial").when(F.col("low") <= 0, "nonpositive_close")
        .when(excess < least, "below").otherwise("event")
    )
    return g.select("sec", "year", "event_date", F.when(F.col("n") == n + 1, excess).alias("excess"), outcome.alias("outcome"))


def name_segments(rows: DataFrame) -> DataFrame:
    """Names folded by (sec, start_date): the states and stars they show and the days they were announced, with those of the segment before.

    rows: (sec, start_date, ann_date, alias); rows without start_date don't form a segment. A segment has a handful of names.
    """
    from eventide.functions.scalars import has_star, name_state

    x = rows.filter("start_date is not null").withColumns({"state": name_state(F.col("alias")), "star": F.coalesce(has_star(F.col("alias")), F.lit(False))})
    g = x.groupBy("sec", "start_date").agg(F.collect_set("state").alias("states"), F.bool_or("star").alias("star_any"), F.bool_and("star").alias("star_all"), F.count_distinct("ann_date").alias("anns"), F.min("ann_date").alias("ann_date"))
    g = g.withColumn("state", F.when(F.size("states") == 1, F.get("states", F.lit(0))).otherwise("mixed"))
    return g.withColumn("prev", F.lag(F.struct("start_date", "state", "states", "star_any")).over(Window.partitionBy("sec").orderBy("start_date")))


def state_changes(segments: DataFrame, before: str, after: str, *, start: str, end: str) -> DataFrame:
    """What becomes of each change of name state: (sec, prev_start, start_date, ann_date, variant, outcome). segments: those of name_segments().

    A segment with names of several states can't be judged if the change may be in it. variant: starred or plain, of the new names.
    """
    clean = (F.col("prev.state") == before) & (F.col("state") == after)
    unclear = ((F.col("prev.state") == "mixed") | (F.col("state") == "mixed")) & F.array_contains("prev.states", before) & F.array_contains("states", after)
    x = segments.filter("prev is not null").withColumn("unclear", unclear).filter(clean | F.col("unclear"))
    ann = F.col("ann_date")
    early = (
        F.when(F.col("unclear"), "unjudgeable").when(F.col("anns") == 0, "anchor_missing").when(F.col("anns") > 1, "anchor_conflict").when(ann > F.col("start_date"), "announced_after")
        .when((ann < F.lit(start).cast("date")) | (ann >= F.lit(end).cast("date")), "out_of_period")
    )
    x = x.withColumn("early", early)
    same = F.count(F.when(F.col("early").isNull(), 1)).over(Window.partitionBy("sec", "ann_date"))
    outcome = F.coalesce("early", F.when(same > 1, "duplicate_event_key"), F.lit("event"))
    return x.select("sec", F.col("prev.start_date").alias("prev_start"), "start_date", F.when(F.col("anns") == 1, ann).alias("ann_date"), F.when(F.col("star_any"), "starred").otherwise("plain").alias("variant"), outcome.alias("outcome"))


def star_changes(segments: DataFrame) -> DataFrame:
    """How often a star went or came while the state stayed, and how often such a security was delisted."""
    was, st = F.col("prev.state") == "st", F.col("state") == "st"
    return segments.filter("prev is not null").agg(
        F.count_if(was & st & F.col("prev.star_any") & ~F.col("star_any")).alias("destar"), F.count_if(was & st & ~F.col("prev.star_any") & F.col("star_any")).alias("star_on"), F.count_if(was & (F.col("state") == "delist")).alias("st_to_delist"), F.count("*").alias("changes")
    )


def trigger_days(index: DataFrame, calendar: DataFrame, members: DataFrame, *, least: float = 0.03) -> DataFrame:
    """Days on which the index moved by `least`, mapped to the next open day; days that two triggers reach are dropped; members by interval."""
    from eventide.sources.readers import first_day_from

    w = Window.orderBy("d")  # one row per day: a bounded axis
    t = index.withColumn("ret", F.col("c") / F.lag("c").over(w) - 1).filter(F.abs("ret") >= least).withColumn("t", F.date_add("d", 1))
    mapped = first_day_from(t, calendar, "t").filter("cal_idx is not null").groupBy("cal_idx").agg(F.count("*").alias("n"), F.first("ret").alias("ret")).filter("n = 1")
    days = mapped.join(calendar, "cal_idx").select("d", "ret", F.year("d").alias("y"))
    hit = days.join(members.withColumn("y", F.explode(F.sequence(F.year("in_date"), F.year("out_date")))), "y")
    return hit.filter((F.col("d") >= F.col("in_date")) & (F.col("d") < F.col("out_date"))).select("d", "sec", F.when(F.col("ret") > 0, "up").otherwise("down").alias("direction"))


def revision_days(rows: DataFrame, *, start: str, end: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """What becomes of each day of a chain of disclosures: (sec, end_date, first_ann_date, ann_date, base_date, outcome).

    rows: (sec, ann_date, end_date, first_ann_date, lo, hi); a chain is (sec, end_date, first_ann_date). Repeated rows are one. Rows without anchor and rows before
    their chain's beginning have the outcomes missing_anchor and temporal_violation and form no chain. A later day in [start, end) is compared with the chain's latest day
    before it, whenever that was. Days of one security that point both ways are same_day_direction_conflict.
    """
    from eventide.functions.scalars import midpoint

    x = rows.select("sec", "ann_date", "end_date", "first_ann_date", "lo", "hi").distinct().withColumn("v", midpoint(F.col("lo"), F.col("hi")))
    bad = F.when(F.col("first_ann_date").isNull() | F.col("end_date").isNull(), "missing_anchor").when(F.col("ann_date") < F.col("first_ann_date"), "temporal_violation")
    x = x.withColumn("bad", bad)
    lost = x.filter("bad is not null").select("sec", "end_date", "first_ann_date", "ann_date", F.lit(None).cast("date").alias("base_date"), F.col("bad").alias("outcome"))
    chain = ["sec", "end_date", "first_ann_date"]
    day = x.filter("bad is null").groupBy(*chain, "ann_date").agg(F.bool_or(F.col("v").isNull()).alias("gap"), F.count_distinct("v").alias("kinds"), F.min("v").alias("v"))
    day = day.withColumn("state", F.when(F.col("gap"), "undecidable").when(F.col("kinds") > 1, "inconsistent"))
    by = Window.partitionBy(*chain)
    firsts = day.select(*chain).distinct().groupBy("sec", "end_date").agg(F.count("*").alias("chains"))
    day = day.withColumns({"base": F.lag(F.struct("ann_date", "state", "v")).over(by.orderBy("ann_date")), "opened": F.max((F.col("ann_date") == F.col("first_ann_date")).cast("int")).over(by)})
    c = day.filter((F.col("ann_date") != F.col("first_ann_date")) & (F.col("ann_date") >= F.lit(start).cast("date")) & (F.col("ann_date") < F.lit(end).cast("date"))).join(firsts, ["sec", "end_date"])
    v, base = F.col("v"), F.col("base.v")
    outcome = (
        F.when(F.col("chains") > 1, "multi_chain").when(F.col("sec").isin(*excluded) if excluded else F.lit(False), "excluded_ticker").when(F.col("opened") == 0, "orphan")
        .when(F.col("state").isNotNull(), F.concat(F.lit("current_"), F.col("state"))).when(F.col("base.state").isNotNull(), F.concat(F.lit("baseline_"), F.col("base.state")))
        .when(v > base, "up").when(v < base, "down").otherwise("flat")
    )
    c = c.withColumn("outcome", outcome)
    way = F.when(F.col("outcome").isin("up", "down"), F.col("outcome"))
    one = Window.partitionBy("sec", "ann_date")
    both = F.min(way).over(one) != F.max(way).over(one)
    c = c.withColumn("outcome", F.when(way.isNotNull() & both, "same_day_direction_conflict").otherwise(F.col("outcome")))
    return c.select(*chain, "ann_date", F.col("base.ann_date").alias("base_date"), "outcome").unionByName(lost)


def revision_events(days: DataFrame) -> DataFrame:
    """One event for each security and day, with the number of its chains."""
    return days.filter("outcome in ('up', 'down')").groupBy("sec", "ann_date").agg(F.first("outcome").alias("direction"), F.count("*").alias("member_chains"))


def final_keys(rows: DataFrame, directions: tuple[str, ...], *, key: tuple[str, str] = ("sec", "ann_date")) -> DataFrame:
    """Outcomes that are a direction, but share their key with another such row, are duplicate_event_key: all of them."""
    is_event = F.col("outcome").isin(*directions)
    same = F.count(F.when(is_event, 1)).over(Window.partitionBy(*key))
    return rows.withColumn("outcome", F.when(is_event & (same > 1), "duplicate_event_key").otherwise(F.col("outcome")))


def dividend_surprise(rows: DataFrame, *, start: str, end: str) -> DataFrame:
    """What becomes of each annual group: (sec, end_date, ann_date, outcome).

    rows: (sec, end_date, ann_date, div_proc, update_flag, cash, base_date, base_share), cash a decimal. A group needs one initial plan with an amount; it is compared with the
    year's before, +-50 % inclusive. Later groups than `end` aren't known yet; of those before `start` only the amounts count.
    """
    x = rows.filter((F.month("end_date") == 12) & (F.day("end_date") == 31) & F.col("ann_date").isNotNull() & (F.col("ann_date") < F.lit(end).cast("date")))
    first = (F.col("div_proc") == "预案") & (F.col("update_flag") == "0")
    seen = F.struct("ann_date", F.col("cash").cast("string").alias("c"), "base_date", F.col("base_share").cast("string").alias("b"))
    g = x.groupBy("sec", "end_date").agg(F.count_if(first).alias("n"), F.size(F.collect_set(F.when(first, seen))).alias("kinds"), F.min(F.when(first, F.col("ann_date"))).alias("ann_date"), F.min(F.when(first, F.col("cash"))).alias("v"))
    bad = (
        F.when(F.col("n") == 0, "initial_missing").when((F.col("n") > 1) & (F.col("kinds") > 1), "initial_multiple_conflict").when(F.col("n") > 1, "initial_multiple_identical")
        .when(F.col("v").isNull() | (F.col("v") < 0), "initial_required_invalid")
    )
    g = g.withColumn("bad", bad)
    prior = g.select("sec", F.add_months("end_date", 12).alias("end_date"), F.lit(True).alias("there"), F.when(F.col("bad").isNull(), F.col("v")).alias("p"))
    half = lambda k: F.col("p") * F.lit(k).cast("decimal(2,1)")
    outcome = (
        F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("ann_date") < F.lit(start).cast("date"), "before_period").when(F.col("there").isNull(), "missing_prior").when(F.col("p").isNull(), "unresolvable_prior").when(F.col("p") == 0, "zero_undefined")
        .when(F.col("v") >= half("1.5"), "up").when(F.col("v") <= half("0.5"), "down").otherwise("inside")
    )
    out = g.join(prior, ["sec", "end_date"], "left").select("sec", "end_date", "ann_date", outcome.alias("outcome"))
    return final_keys(out, ("up", "down"))


def flash_gap(express: DataFrame, forecasts: DataFrame, *, start: str, end: str) -> DataFrame:
    """What becomes of each group of quick reports: (sec, end_date, ann_date, forecast_date, outcome).

    express: (sec, end_date, ann_date, update_flag, v); forecasts: (sec, end_date, ann_date, lo, hi). A group needs one row with flag 0; it is compared with the latest day
    strictly before it that has complete forecasts (lo <= hi), all of which must be the same interval.
    """
    key = ["sec", "end_date"]
    x = express.filter((F.col("ann_date") >= F.lit(start).cast("date")) & (F.col("ann_date") < F.lit(end).cast("date")))
    zero = F.col("update_flag") == "0"
    g = x.groupBy(*key).agg(F.count_if(zero).alias("n"), F.min(F.when(zero, F.col("ann_date"))).alias("ann_date"), F.min(F.when(zero, F.col("v"))).alias("v"))
    whole = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))
    f = forecasts.filter("ann_date is not null").withColumnRenamed("ann_date", "f_date").withColumn("iv", F.when(whole, F.struct("lo", "hi")))
    # a group has few forecasts: they meet its one report by an equality
    m = g.filter("n = 1").join(f, key).groupBy(*key).agg(
        F.count("*").alias("all"), F.count_if(F.col("f_date") < F.col("ann_date")).alias("prior"), F.max(F.when((F.col("f_date") < F.col("ann_date")) & F.col("iv").isNotNull(), F.col("f_date"))).alias("forecast_date")
    )
    latest = m.select(*key, F.col("forecast_date").alias("f_date")).join(f.filter("iv is not null"), [*key, "f_date"]).groupBy(*key).agg(F.count_distinct("iv").alias("kinds"), F.min("iv").alias("iv"))
    y = g.join(m, key, "left").join(latest, key, "left")
    v, lo, hi = F.col("v"), F.col("iv.lo"), F.col("iv.hi")
    outcome = (
        F.when(F.col("n") == 0, "flag0_missing").when(F.col("n") > 1, "flag0_multiple").when(F.col("all").isNull(), "orphan").when(F.col("prior") == 0, "no_strict_prior").when(F.col("forecast_date").isNull(), "no_complete_prior")
        .when(F.col("kinds") > 1, "forecast_conflict").when(v.isNull(), "actual_null").when(v > hi, "up").when(v < lo, "down").when((v == hi) | (v == lo), "boundary").otherwise("inside")
    )
    one = F.col("n") == 1
    out = y.select(*key, F.when(one, F.col("ann_date")).alias("ann_date"), F.when(one & (F.col("kinds") == 1), F.col("forecast_date")).alias("forecast_date"), outcome.alias("outcome"))
    return final_keys(out, ("up", "down"))


def pullback_events(outcomes: DataFrame, *, start: str, end: str) -> DataFrame:
    """The touches that are events, by study range; days that two stages reach are duplicates. outcomes: those of high_pullback()."""
    x = outcomes.filter("outcome = 'EVENT'")
    same = F.count("*").over(Window.partitionBy("sec", "d"))
    d = F.col("d")
    why = F.when(same > 1, "duplicate_event_key").when(d < F.lit(start).cast("date"), "before_range").when(d >= F.lit(end).cast("date"), "after_range").otherwise("event")
    return x.select("sec", "anchor_d", "d", why.alias("outcome"))
