"""Event selection with every reject reason: limit chains (R01, R02), holders' sales (R03), ex-rights gaps (R10), holding paths.

Each function returns all candidates with an outcome, so that funnels can be counted and checked. Nothing folds over
rows: chains and episodes are numbered by running sums, and what comes next is found in windows that run backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import titles as T
from eventide.functions.scalars import beijing_date

RECENT, NEAR_EX = 30, "0.5"


def forward():
    return Window.partitionBy("sec").orderBy("d")


def backward():
    """From the last row back: what a row sees are the rows after it, at a cost linear in the rows."""
    return Window.partitionBy("sec").orderBy(F.desc("d"))


def listing_anomaly(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """(sec, listing_reason): why a security's bars contradict its listing. listing: (sec, list_date, delist_date)."""
    ends = rows.groupBy("sec").agg(F.min("d").alias("first_bar"), F.max("d").alias("last_bar"))
    x = ends.join(listing, "sec", "left")
    bad = (F.col("delist_date") <= F.col("list_date")) | (F.col("last_bar") >= F.col("delist_date"))
    reason = F.when(F.col("list_date").isNull(), "listing_missing").when(F.col("first_bar") < F.col("list_date"), "pre_listing_bar").when(bad, "listing_window_anomaly")
    return x.select("sec", reason.alias("listing_reason"))


def limit_chains(rows: DataFrame, listing: DataFrame, *, side: str, start: str, end: str, least: int = 2, by_calendar: bool = False) -> DataFrame:
    """R01 (side 'up'), R02 (side 'down'): runs of one-word days at that limit and the first day after them that isn't one-word.

    rows: (sec, d, cal_idx, one_word, open_at): one_word whether the day traded at one price, a limit; open_at 'up', 'down' or 'none'.
    Days in between that are one-word still are skipped and counted by where they opened. Up chains are rejected in the order listing, right
    censored, out of range, duplicate day; down chains in the order right censored, before, after, listing, duplicate day, reversal.
    by_calendar splits chains where the calendar has an open day between two rows.
    """
    member = F.col("one_word") & (F.col("open_at") == side)
    kinds = {"up": F.col("open_at") == "up", "down": F.col("open_at") == "down", "anom": ~F.col("open_at").isin("up", "down")}
    x = rows.withColumns({"seq": F.row_number().over(forward()), "member": member, "before": F.lag(member).over(forward()), "gap": F.col("cal_idx") - F.lag("cal_idx").over(forward())})
    fresh = ~F.coalesce(F.col("before"), F.lit(False))
    if by_calendar:
        fresh = fresh | (F.col("gap") != 1)
    running = forward().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("chain", F.sum(F.when(fresh & F.col("member"), 1).otherwise(0)).over(running))
    x = x.withColumns({k: F.sum((F.col("one_word") & v).cast("long")).over(running) for k, v in kinds.items()})
    free = F.when(~F.col("one_word"), F.struct("d", *kinds))
    x = x.withColumns({
        "next": F.last(free, ignorenulls=True).over(backward().rowsBetween(Window.unboundedPreceding, -1)),
        "end": F.first(F.struct(*kinds)).over(backward()),
    })
    last = lambda c: F.max_by(c, "seq")
    chains = x.filter("member").groupBy("sec", "chain").agg(
        F.min("d").alias("chain_start"), F.max("d").alias("chain_end"), F.count("*").alias("chain_len"), F.min("seq").alias("start_rank"),
        last("next").alias("next"), last("end").alias("end"), *(last(k).alias(k) for k in kinds),
    ).filter(F.col("chain_len") >= least)
    skipped = {f"deferred_{k}": F.coalesce(F.col(f"next.{k}"), F.col(f"end.{k}")) - F.col(k) for k in kinds}
    c = chains.join(listing_anomaly(rows, listing), "sec", "left").withColumns(skipped).withColumns({"event_date": F.col("next.d"), "recent_listing": F.col("start_rank") <= RECENT})
    day, censored, bad = F.col("event_date"), F.col("event_date").isNull(), F.col("listing_reason")
    early, late = day < F.lit(start).cast("date"), day >= F.lit(end).cast("date")
    if side == "up":
        early_reason = F.when(bad.isNotNull(), bad).when(censored, "right_censored").when(early | late, "out_of_range")
    else:
        early_reason = F.when(censored, "right_censored").when(early, "before_range").when(late, "after_range").when(bad.isNotNull(), bad)
    c = c.withColumn("outcome", early_reason)
    same = F.count(F.when(F.col("outcome").isNull(), 1)).over(Window.partitionBy("sec", "event_date"))
    outcome = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(same > 1, "duplicate_day")
    if side == "down":
        outcome = outcome.when(F.col("deferred_up") >= 1, "reversal_hijack")
    return c.withColumn("outcome", outcome.otherwise("event")).select("sec", "chain_start", "chain_end", "chain_len", "start_rank", "recent_listing", *skipped, "event_date", "outcome")


def holder_sales(rows: DataFrame, listing: DataFrame, pair_drops: DataFrame, passes: DataFrame, *, least_pct: float = 1.0) -> DataFrame:
    """Announcements with the reason that rejects each (NULL: a first plan of at least `least_pct` percent).

    rows: (announcement_id, seq, title, ts_code, stock_code, holder_name, ratio, period_start, period_end, valid_time), seq the order of the source.
    listing: (ts_code, list_date, delist_date). pair_drops: (announcement_id, verdict). passes: (announcement_id, ok, why, new_ratio), the
    judged titles that mix progress with a new plan.
    """
    one = Window.partitionBy("announcement_id")
    x = rows.join(listing, "ts_code", "left").withColumns({
        "codes": F.size(F.collect_set(F.coalesce("stock_code", F.lit(""))).over(one)), "place": F.row_number().over(one.orderBy("seq")),
        "day0": F.first(beijing_date(F.col("valid_time"))).over(one.orderBy("seq")),
    })  # an id has a handful of rows
    listed = (F.col("day0") >= F.col("list_date")) & (F.col("delist_date").isNull() | (F.col("day0") < F.col("delist_date")))
    x = x.withColumn("hit", F.coalesce(listed, F.lit(False))).withColumn("hits", F.sum(F.col("hit").cast("int")).over(one))
    reason = (
        F.when((F.col("codes") == 1) & (F.col("place") > 1), "dup_announcement_id").when((F.col("codes") > 1) & (F.col("hits") != 1), "pit_attribution_unresolved")
        .when((F.col("codes") > 1) & ~F.col("hit"), "pit_attribution_other_code")
    )
    x = x.withColumns({"reason": reason, "class": T.reduction_title(F.col("title"))})
    x = x.join(pair_drops, "announcement_id", "left").join(passes, "announcement_id", "left")
    mixed = F.col("class") == "first_with_progress"
    judged = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("class").isin("first_candidate", "first_with_progress"), F.col("class")).when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(mixed & F.col("ok").isNull(), "fwp_not_adjudicated").when(mixed & ~F.col("ok"), F.concat(F.lit("fwp_rejected_"), F.coalesce("why", F.lit("fail_closed"))))
    )
    x = x.withColumns({"reason": judged, "ratio": F.when(mixed & F.col("new_ratio").isNotNull(), F.col("new_ratio")).otherwise(F.col("ratio"))})
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("stock_code", "holder_name", "period_start", "period_end")]
    whole = F.col("reason").isNull()
    for p in parts:
        whole = whole & p.isNotNull()
    # rows without the whole key are each a group of their own
    key = F.when(whole, F.concat_ws("\u0001", *parts)).otherwise(F.concat(F.lit("\u0002"), F.col("announcement_id").cast("string"), F.lit("\u0001"), F.col("seq").cast("string")))
    plan = F.row_number().over(Window.partitionBy("key").orderBy("valid_time", F.col("announcement_id").cast("string")))
    x = x.withColumn("key", key).withColumn("nth", plan)
    final = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("nth") > 1, "same_plan_strong_key").when(F.col("ratio").isNull(), "ratio_unparsed_fail_closed")
        .when(F.col("ratio") < least_pct, "ratio_below_gate")
    )
    return x.select("announcement_id", "seq", "ts_code", "class", "ratio", beijing_date(F.col("valid_time")).alias("event_date"), final.alias("reason"))


def holder_sale_events(selected: DataFrame) -> DataFrame:
    """One event for each security and day."""
    return selected.filter("reason is null").groupBy("ts_code", "event_date").agg(F.count("*").alias("n_ann"), F.sort_array(F.collect_list("announcement_id")).alias("announcement_ids"))


def ex_rights(rows: DataFrame, factors: DataFrame, calendar: DataFrame, *, least: str = NEAR_EX, start: str, end: str) -> DataFrame:
    """What becomes of each (sec, end_date) group of implemented distributions; 'factor_changed' is the event.

    rows: (sec, end_date, ex_date, imp_ann_date, record_date, stk_div, stk_bo, stk_co), decimals. factors: (sec, d, factor). The factor of the ex day is
    compared with that of the open day before it, whether or not the security traded on it.
    """
    scoped = rows.filter(F.col("ex_date").isNotNull() & (F.col("ex_date") >= F.lit(start).cast("date")) & (F.col("ex_date") < F.lit(end).cast("date")))
    zero = F.lit(0)
    bad = (
        F.when(F.col("end_date").isNull() | F.col("imp_ann_date").isNull() | F.col("stk_div").isNull(), "required_invalid").when(F.col("imp_ann_date") >= F.col("ex_date"), "timing_invalid")
        .when((F.col("stk_bo").isNull() & F.col("stk_co").isNull()) | (F.col("stk_div") != F.coalesce("stk_bo", zero) + F.coalesce("stk_co", zero)), "component_invalid")
    )
    fields = ["ex_date", "stk_div", "stk_bo", "stk_co", "imp_ann_date", "record_date"]
    gaps = F.lit(False)
    for f in fields:
        gaps = gaps | F.col(f).isNull()
    order = F.struct(F.coalesce(F.col("imp_ann_date"), F.lit("1900-01-01").cast("date")), "ex_date", "stk_div")
    g = scoped.withColumn("bad", bad).groupBy("sec", "end_date").agg(
        F.count("*").alias("n"), F.min_by("bad", F.when(F.col("bad").isNotNull(), order)).alias("bad"), F.bool_or(gaps).alias("gaps"), F.count_distinct(F.struct(*fields)).alias("kinds"),
        F.min("ex_date").alias("ex_date"), F.min("stk_div").alias("total"),
    )
    g = g.withColumn("outcome", F.when(F.col("bad").isNotNull(), F.col("bad")).when((F.col("n") > 1) & F.col("gaps"), "multi_null").when(F.col("kinds") > 1, "multi_conflict").when(F.col("total") < F.lit(least).cast("decimal(10,4)"), "below_threshold"))
    same = F.count(F.when(F.col("outcome").isNull(), 1)).over(Window.partitionBy("sec", "ex_date"))
    g = g.withColumn("outcome", F.coalesce("outcome", F.when(same > 1, "duplicate_event_key")))
    axis = F.broadcast(calendar.select(F.col("d").alias("ex_date"), F.lag("d").over(Window.orderBy("d")).alias("prev_d")))  # a bounded axis
    f = factors.groupBy("sec", "d").agg(F.count_distinct("factor").alias("kinds"), F.min("factor").alias("factor"), F.bool_or(F.col("factor").isNull() | (F.col("factor") <= 0)).alias("invalid"))
    f = f.select("sec", "d", F.struct(F.when(~F.col("invalid") & (F.col("kinds") == 1), F.col("factor")).alias("v")).alias("f"))
    at = g.drop("kinds").join(axis, "ex_date", "left").join(f.select("sec", F.col("d").alias("ex_date"), F.col("f").alias("now")), ["sec", "ex_date"], "left").join(f.select("sec", F.col("d").alias("prev_d"), F.col("f").alias("was")), ["sec", "prev_d"], "left")
    factor = (
        F.when(F.col("prev_d").isNull(), "calendar_missing").when(F.col("now").isNull(), "current_missing").when(F.col("was").isNull(), "previous_missing")
        .when(F.col("now.v").isNull() | F.col("was.v").isNull(), "factor_invalid").when(F.col("now.v") == F.col("was.v"), "factor_static").otherwise("factor_changed")
    )
    return at.select("sec", "end_date", "ex_date", "total", F.coalesce("outcome", factor).alias("outcome"), F.try_divide(F.col("now.v").cast("double"), F.col("was.v").cast("double")).alias("factor_ratio"))


def regime(d: Column) -> Column:
    """P27. The days on which the rules for distributions changed."""
    return F.when(d < F.lit("2017-01-01").cast("date"), "pre_2017").when(d < F.lit("2018-11-23").cast("date"), "enforcement_transition").otherwise("exchange_rule_period")


def drawdown_entries(rows: DataFrame, *, depth: str = "0.90", days: int = 3) -> DataFrame:
    """R14 with its diagnostics: (sec, d, episode_start, d1, d2, d3) of each entry.

    rows: (sec, d, close, own_idx, h60, sum10, sum20), decimals. An episode is a stay in the zone close <= depth x the 60-bar high; the first row of it whose
    own and two earlier rows of the episode stand above the 10-bar mean and not below the 20-bar mean is the entry. d1: no close at or
    below the 10-bar mean since the episode began; d2: bars since then; d3: a close below the 20-bar mean since then.
    """
    c = F.col("close")
    ready = F.col("h60").isNotNull() & F.col("sum10").isNotNull() & F.col("sum20").isNotNull()
    zone = ready & (c <= F.col("h60") * F.lit(depth).cast("decimal(3,2)"))
    x = rows.withColumn("inside", F.coalesce(zone, F.lit(False))).withColumn("episode", F.sum((~F.col("inside")).cast("int")).over(forward().rowsBetween(Window.unboundedPreceding, 0))).filter("inside")
    x = x.withColumns({"over10": c * 10 > F.col("sum10"), "under20": c * 20 < F.col("sum20")})
    w = Window.partitionBy("sec", "episode").orderBy("d")
    so_far, few = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - days, 0)
    x = x.withColumns({
        "n": F.sum((F.col("over10") & ~F.col("under20")).cast("int")).over(few), "start": F.first(F.struct("d", "own_idx")).over(so_far),
        "d1": F.min(F.col("over10")).over(so_far), "d3": F.max(F.col("under20")).over(so_far),
    })
    first = x.filter(F.col("n") == days).groupBy("sec", "episode").agg(F.min(F.struct("d", "own_idx", "start", "d1", "d3")).alias("e"))
    return first.select("sec", "e.d", F.col("e.start.d").alias("episode_start"), "e.d1", (F.col("e.own_idx") - F.col("e.start.own_idx")).cast("long").alias("d2"), "e.d3")


STRETCH, EXTREME = 250, 20


def holding_paths(entries: DataFrame, rows: DataFrame, *, mode: str = "next_open", stop: str = "0.80") -> DataFrame:
    """From the entry bar the first close at or below stop x the entry's open, or below the 20-bar mean, and how it is filled.

    entries: (event_id, sec, d). rows: (sec, d, cal_idx, open, close, status, open_status, sum20, own_idx). mode 'next_open': the next bar whose open is above zero and
    not at the lower limit; days late count from the bar after the trigger. mode 'same_close': the trigger's close, or the next close that isn't stuck at the
    lower limit; days late count from the trigger. Without a fill, or a trigger, the last close marks the path as right censored. No row where the entry has no open.
    """
    if mode not in ("next_open", "same_close"):
        raise ValueError(f"no such mode: {mode}")
    prev = F.lag("close").over(forward())
    stuck = (F.col("status") == "limit_down") | ((F.col("status") == "one_word") & F.coalesce(F.col("close") < prev, F.lit(False)))
    opens = F.coalesce(F.col("open") > 0, F.lit(False)) & (F.col("open_status") != "limit_down")
    bar = lambda price: F.struct("d", "own_idx", "cal_idx", F.col(price).alias("price"))
    after, from_here = backward().rowsBetween(Window.unboundedPreceding, -1), backward().rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.col("own_idx") >= 20, F.lit(False)) & (F.col("close") * 20 < F.col("sum20"))
    fill = F.last(F.when(opens, bar("open")), ignorenulls=True).over(after) if mode == "next_open" else F.last(F.when(~F.col("stuck"), bar("close")), ignorenulls=True).over(from_here)
    x = rows.withColumn("stuck", stuck).withColumns({
        "below": below, "fill": fill, "end": F.first(bar("close")).over(backward()), "then": F.lead(F.struct("own_idx", "cal_idx")).over(forward()),
        "until": F.last(F.when(below, F.col("own_idx")), ignorenulls=True).over(from_here),
    })
    at = entries.join(x.select("sec", "d", F.col("own_idx").alias("entry_idx"), F.col("open").alias("entry"), "until", "end"), ["sec", "d"]).filter("entry > 0").withColumnRenamed("d", "entry_d")
    # the stop can only come up to the first close below the mean (or the last bar): a path reads those bars, by stretches of bars
    stretch = lambda i: F.floor(i / STRETCH).cast("int")
    upto = F.coalesce("until", F.col("end.own_idx"))
    span = at.withColumn("upto", upto).withColumn("stretch", F.explode(F.sequence(stretch(F.col("entry_idx")), stretch(F.col("upto")))))
    bars = x.select("sec", stretch(F.col("own_idx")).alias("stretch"), F.struct("own_idx", "d", "cal_idx", "close", "below", "fill", "then").alias("b"))
    stopped = F.col("b.close") <= F.col("entry") * F.lit(stop).cast("decimal(3,2)")
    hit = span.join(bars, ["sec", "stretch"]).filter((F.col("b.own_idx") >= F.col("entry_idx")) & (F.col("b.own_idx") <= F.col("upto"))).withColumn("stopped", stopped).filter(F.col("stopped") | F.col("b.below"))
    first = hit.groupBy("event_id").agg(F.min(F.struct(F.col("b.own_idx"), "b", "stopped")).alias("t"))
    p = at.join(first, "event_id", "left")
    b, none = F.col("t.b"), F.col("t").isNull()
    filled = ~none & b["fill"].isNotNull()
    out = F.when(filled, b["fill"]).otherwise(F.col("end"))
    place = lambda s: F.struct(s["own_idx"].alias("own_idx"), s["cal_idx"].alias("cal_idx"))
    nominal = place(b) if mode == "same_close" else F.when(b["then"].isNotNull(), place(b["then"])).otherwise(place(F.col("end")))
    late_bars = F.when(none, 0).otherwise(out["own_idx"] - nominal["own_idx"])
    late_days = F.when(none, 0).otherwise(out["cal_idx"] - nominal["cal_idx"])
    now, late = ("next_open", "postponed_open") if mode == "next_open" else ("same_close", "postponed_close")
    return p.select(
        "event_id", "sec", "entry_d", "entry", b["d"].alias("trigger_d"), F.when(none, "right_censored").when(F.col("t.stopped"), "stop_loss").otherwise("break_ma20").alias("reason"),
        F.coalesce("t.stopped", F.lit(False)).alias("by_stop"), F.coalesce(b["below"], F.lit(False)).alias("by_mean"), out["d"].alias("exit_d"), out["price"].alias("exit"),
        (out["own_idx"] - F.col("entry_idx")).cast("long").alias("held_bars"), late_bars.cast("long").alias("late_bars"), late_days.cast("long").alias("late_days"), (late_days > EXTREME).alias("extreme"),
        (~filled).alias("censored"), F.when(~filled, "censored_close_mark").when(late_bars == 0, now).otherwise(late).alias("fill_source"),
    )


def strategy(paths: DataFrame, market: DataFrame, calendar: DataFrame, sds: DataFrame, *, buy: float = 0.00125, sell: float = 0.00225) -> DataFrame:
    """Returns of paths against holding the market: (event_id, ..., gross, net, bench, bhar, bhar_gross, sbhar, sbhar_gross, held_days, excluded).

    market: (cal_idx, rm), log returns; sds: (event_id, sd), of estimation residuals. A path is excluded as 'bench_gap' if a day of its span has no market return, and
    as 'sbhar_none' if its sd isn't above zero.
    """
    w = Window.orderBy("cal_idx").rowsBetween(Window.unboundedPreceding, 0)  # a bounded axis
    sums = calendar.join(market, "cal_idx", "left").select("d", "cal_idx", F.coalesce(F.sum("rm").over(w), F.lit(0.0)).alias("s"), F.count("rm").over(w).alias("n"))
    at = lambda name, day, shift: F.broadcast(sums.select(F.col("d").alias(day), F.struct((F.col("cal_idx") - shift).alias("i"), F.col("s"), F.col("n")).alias(name)))
    before = sums.select((F.col("cal_idx") + 1).alias("i0"), F.struct("s", "n").alias("z"))
    x = paths.join(at("a", "entry_d", 0), "entry_d", "left").join(at("b", "exit_d", 0), "exit_d", "left").withColumn("i0", F.col("a.i")).join(F.broadcast(before), "i0", "left").join(sds, "event_id", "left")
    held = F.col("b.i") - F.col("a.i") + 1
    whole = F.col("b.n") - F.coalesce(F.col("z.n"), F.lit(0)) == held
    bench = F.when(whole, F.exp(F.col("b.s") - F.coalesce(F.col("z.s"), F.lit(0.0))) - 1)
    entry, exit_ = F.col("entry").cast("double"), F.col("exit").cast("double")
    x = x.withColumns({"gross": exit_ / entry - 1, "net": exit_ * (1 - sell) / (entry * (1 + buy)) - 1, "bench": bench, "held_days": held.cast("long")})
    x = x.withColumns({"bhar": F.col("net") - F.col("bench"), "bhar_gross": F.col("gross") - F.col("bench")})
    scale = F.col("sd") * F.sqrt(F.col("held_days").cast("double"))
    x = x.withColumns({"sbhar": F.when(F.col("sd") > 0, F.col("bhar") / scale), "sbhar_gross": F.when(F.col("sd") > 0, F.col("bhar_gross") / scale)})
    excluded = F.when(F.col("bench").isNull(), "bench_gap").when(F.col("sbhar").isNull(), "sbhar_none")
    return x.select(*paths.columns, "gross", "net", "bench", "bhar", "bhar_gross", "sbhar", "sbhar_gross", "held_days", excluded.alias("excluded"))
