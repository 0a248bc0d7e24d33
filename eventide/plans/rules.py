"""Queries of the event-selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.operators import returns as R
from eventide.operators import rules as X
from eventide.plans.market import LN
from eventide.registry import ORACLES, query
from eventide.sources.panel import bars, calendar, first_events, panel_sql, read

W = "OVER (PARTITION BY sec ORDER BY d)"


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moving(bars(spark, sf_dir)).join(F.broadcast(calendar(spark, sf_dir)), "d")


# Orders are disclosures of a customer group for a year; most groups have one chain a year.

CHAIN_SQL = """b AS (SELECT 'S' || (o_custkey % 400) AS sec, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k FROM orders),
f AS (SELECT sec, k, CASE WHEN k % 41 <> 0 THEN make_date(year(day), 12, 31) END AS end_date, CASE WHEN k % 37 <> 0 THEN make_date(year(day), 3, CAST(10 + CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS INTEGER)) END AS first_ann_date,
  make_date(year(day), 3, 10) + CAST([0, 30, 60, 0, -5, 90][k % 6 + 1] AS INTEGER) AS ann_date, CASE WHEN k % 11 <> 0 THEN CAST(k % 7 AS DOUBLE) END AS lo, CASE WHEN k % 5 <> 0 THEN CAST(k % 7 + k % 3 AS DOUBLE) END AS hi FROM b),
x AS (SELECT DISTINCT sec, ann_date, end_date, first_ann_date, lo, hi, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE coalesce(lo, hi) END AS v,
  CASE WHEN first_ann_date IS NULL OR end_date IS NULL THEN 'missing_anchor' WHEN ann_date < first_ann_date THEN 'temporal_violation' END AS bad FROM f),
dy AS (SELECT sec, end_date, first_ann_date, ann_date, CASE WHEN count(*) > count(v) THEN 'undecidable' WHEN count(DISTINCT v) > 1 THEN 'inconsistent' END AS state, min(v) AS v FROM x WHERE bad IS NULL GROUP BY 1, 2, 3, 4),
ch AS (SELECT sec, end_date, count(DISTINCT first_ann_date) AS chains FROM dy GROUP BY 1, 2),
cd AS (SELECT c.*, chains, (SELECT max(ann_date) FROM dy p WHERE p.sec = c.sec AND p.end_date = c.end_date AND p.first_ann_date = c.first_ann_date AND p.ann_date < c.ann_date) AS base_date,
  EXISTS (SELECT 1 FROM dy p WHERE p.sec = c.sec AND p.end_date = c.end_date AND p.first_ann_date = c.first_ann_date AND p.ann_date = p.first_ann_date) AS opened
  FROM dy c JOIN ch ON ch.sec = c.sec AND ch.end_date = c.end_date WHERE c.ann_date <> c.first_ann_date AND c.ann_date >= DATE '1996-01-01' AND c.ann_date < DATE '2000-05-01'),
oc AS (SELECT cd.*, CASE WHEN chains > 1 THEN 'multi_chain' WHEN cd.sec = 'S7' THEN 'excluded_ticker' WHEN NOT opened THEN 'orphan' WHEN cd.state IS NOT NULL THEN 'current_' || cd.state WHEN b.state IS NOT NULL THEN 'baseline_' || b.state WHEN cd.v > b.v THEN 'up' WHEN cd.v < b.v THEN 'down' ELSE 'flat' END AS o
  FROM cd LEFT JOIN dy b ON b.sec = cd.sec AND b.end_date = cd.end_date AND b.first_ann_date = cd.first_ann_date AND b.ann_date = base_date),
dc AS (SELECT sec, end_date, first_ann_date, ann_date, base_date, CASE WHEN o IN ('up', 'down') AND (SELECT count(DISTINCT q.o) FROM oc q WHERE q.sec = oc.sec AND q.ann_date = oc.ann_date AND q.o IN ('up', 'down')) > 1 THEN 'same_day_direction_conflict' ELSE o END AS outcome FROM oc
  UNION ALL SELECT sec, end_date, first_ann_date, ann_date, NULL, bad FROM x WHERE bad IS NOT NULL)"""


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    tenth = F.make_date(y, F.lit(3), F.lit(10))
    shift = F.element_at(F.array(*map(F.lit, (0, 30, 60, 0, -5, 90))), (k % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey") % 400).alias("sec"), F.when(k % 41 != 0, F.make_date(y, F.lit(12), F.lit(31))).alias("end_date"), F.when(k % 37 != 0, F.date_add(tenth, F.when(k % 53 == 0, 1).otherwise(0))).alias("first_ann_date"),
        F.date_add(tenth, shift).alias("ann_date"), F.when(k % 11 != 0, (k % 7).cast("double")).alias("lo"), F.when(k % 5 != 0, (k % 7 + k % 3).cast("double")).alias("hi"),
    )
    return X.revision_days(rows, start="1996-01-01", end="2000-05-01", excluded=("S7",))


@query("r04_earnings_revision", f"WITH {CHAIN_SQL} SELECT * FROM dc")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosures(spark, sf_dir)


@query("r04_revision_events", f"WITH {CHAIN_SQL} SELECT sec, ann_date, min(outcome) AS direction, count(*) AS member_chains FROM dc WHERE outcome IN ('up', 'down') GROUP BY 1, 2")
def r04_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.revision_events(disclosures(spark, sf_dir))


@query("r05_high_pullback", panel_sql(f"""b AS (SELECT sec, d, cal_idx, close, row_number() {W} AS n, max(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pm,
  sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20 FROM bars JOIN cal USING (d)),
a AS (SELECT sec, d AS anchor_d, cal_idx AS a, close AS c0, lead(d) {W} AS next_d, lead(cal_idx) {W} AS next_a FROM b WHERE n > 20 AND close > pm),
h AS (SELECT a.sec, a.anchor_d, min(b.d) AS hd FROM a JOIN b ON b.sec = a.sec AND b.d > a.anchor_d AND (a.next_d IS NULL OR b.d < a.next_d) AND b.cal_idx <= a.a + 10 AND b.close <= a.c0 * 0.97 GROUP BY 1, 2)
SELECT a.sec, a.anchor_d, hd AS d, CASE WHEN hd IS NULL AND next_a <= a.a + 10 THEN 'RESET' WHEN hd IS NULL AND a.a + 10 > (SELECT max(cal_idx) FROM b) THEN 'TRUNCATED' WHEN hd IS NULL THEN 'NO_TOUCH'
  WHEN b.close < c0 * 0.95 THEN 'DEEP_KILL' WHEN 20 * b.close >= s20 THEN 'EVENT' ELSE 'MA_KILL' END AS outcome
FROM a LEFT JOIN h USING (sec, anchor_d) LEFT JOIN b ON b.sec = a.sec AND b.d = hd"""))
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, prior = F.row_number().over(X.own()), F.max("close").over(X.own().rowsBetween(-20, -1))
    rows = moved(spark, sf_dir).withColumns({"new_high": (n > 20) & (F.col("close") > prior), "above_ma": F.sum("close").over(X.own().rowsBetween(-19, 0)) <= F.col("close") * 20})
    return X.high_pullback(rows)


# Bars whose volume 31 divides have no amount.

@query("r06_volume_drought", panel_sql(f"""a AS (SELECT sec, d, cal_idx, open, close, CASE WHEN vol % 31 <> 0 THEN amount END AS amount FROM bars JOIN cal USING (d)),
g AS (SELECT *, CASE WHEN amount IS NULL OR coalesce(cal_idx - lag(cal_idx) {W}, 9) <> 1 THEN 1 ELSE 0 END AS brk FROM a), q AS (SELECT *, sum(brk) {W} AS grp FROM g),
p AS (SELECT *, sum(amount) OVER w AS s, count(*) OVER w AS n FROM q WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), k AS (SELECT *, row_number() {W} AS seq FROM p WHERE n = 10),
outs AS (SELECT sec, grp, d, seq, open, close, coalesce(lag(seq) OVER (PARTITION BY sec, grp ORDER BY seq), -1) AS prev_out FROM k WHERE amount * 10 > s),
low AS (SELECT sec, grp, d, seq, seq - row_number() OVER (PARTITION BY sec, grp ORDER BY seq) AS isl FROM k WHERE amount * 10 < s * 0.60),
runs AS (SELECT sec, grp, min(seq) AS s0, max(seq) AS s1, min(d) AS d0 FROM low GROUP BY sec, grp, isl HAVING count(*) >= 2),
z AS (SELECT o.sec, o.grp, o.d, o.seq, o.open, o.close, min(r.s0) AS s0, min(r.d0) AS low_start FROM outs o JOIN runs r ON r.sec = o.sec AND r.grp = o.grp AND r.s1 < o.seq AND r.s0 > o.prev_out GROUP BY ALL)
SELECT sec, d, CASE WHEN close > open THEN 'event' ELSE 'reject' END AS outcome, low_start, (SELECT count(*) FROM low WHERE low.sec = z.sec AND low.grp = z.grp AND low.seq BETWEEN z.s0 AND z.seq) AS low_days FROM z"""))
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "d").withColumn("amount", F.when(F.col("vol") % 31 != 0, F.col("amount")))
    return X.volume_drought(rows, share="0.60", least=2, days=10)


@query("r07_yearend_strength", panel_sql(f"""r AS (SELECT sec, d, {LN} AS ret FROM bars), m AS (SELECT d, avg(ret) AS rm FROM r WHERE ret IS NOT NULL GROUP BY d),
dc AS (SELECT year(d) AS y, d, row_number() OVER (PARTITION BY year(d) ORDER BY d DESC) AS back FROM cal WHERE month(d) = 12), w AS (SELECT y, min(d) AS d1, max(d) AS d3 FROM dc WHERE back <= 3 GROUP BY y HAVING count(*) = 3),
v AS (SELECT y, d1, d3, (SELECT max(d) FROM cal WHERE d < d1) AS d0, (SELECT min(d) FROM cal WHERE d > d3) AS ev, (SELECT sum(rm) FROM m WHERE d BETWEEN d1 AND d3) AS mk FROM w),
g AS (SELECT sec, y, ev, mk, count(*) AS n, max(close) FILTER (d = d0) AS c0, max(close) FILTER (d = d3) AS c1 FROM bars JOIN v ON d BETWEEN d0 AND d3 WHERE ev IS NOT NULL AND d0 IS NOT NULL GROUP BY ALL),
e AS (SELECT *, CASE WHEN n = 4 THEN exp(ln(CAST(c1 AS DOUBLE)) - ln(CAST(c0 AS DOUBLE)) - mk) - 1 END AS x FROM g)
SELECT sec, y AS year, ev AS event_date, round(x, 8) AS excess, CASE WHEN n < 4 AND c0 IS NULL THEN 'base_missing' WHEN n < 4 THEN 'panel_partial' WHEN x < 0.05 THEN 'below' ELSE 'event' END AS outcome FROM e"""))
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    market, windows = R.market_return(R.gap_returns(b)), X.yearend_windows(calendar(spark, sf_dir), n=3)
    return X.yearend_strength(b, market, windows, n=3).withColumn("excess", F.round("excess", 8))


# Every quarter's first event renames its security; some days have a second name, announced on another day.

RENAME_SQL = """nm AS (SELECT sec, anchor AS start_date, CASE WHEN day(anchor) % 5 <> 0 THEN anchor - CAST(day(anchor) % 4 - 1 AS INTEGER) END AS ann_date, CASE layer WHEN 'good' THEN 'N' || sec WHEN 'bad' THEN '*ST ' || sec ELSE 'ST' || sec END AS alias FROM ev
  UNION ALL SELECT sec, anchor, anchor - 2, CASE WHEN day(anchor) % 2 = 0 THEN 'ST ' || sec ELSE sec || '退' END FROM ev WHERE day(anchor) % 6 = 1),
st AS (SELECT *, CASE WHEN alias LIKE '%退' THEN 'delist' WHEN upper(alias) LIKE '%ST%' THEN 'st' ELSE 'normal' END AS s, alias LIKE '*ST%' AS star FROM nm),
sg AS (SELECT sec, start_date, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'mixed' END AS state, bool_or(s = 'st') AS h_st, bool_or(s = 'normal') AS h_normal, bool_or(star) AS star, count(DISTINCT ann_date) AS anns, min(ann_date) AS ann FROM st GROUP BY sec, start_date),
sp AS (SELECT *, lag(start_date) OVER w AS p_start, lag(state) OVER w AS p_state, lag(h_st) OVER w AS p_st, lag(h_normal) OVER w AS p_normal, lag(star) OVER w AS p_star FROM sg WINDOW w AS (PARTITION BY sec ORDER BY start_date))"""


def change_sql(before: str, after: str) -> str:
    unclear = f"(p_state = 'mixed' OR state = 'mixed') AND p_{before} AND h_{after}"
    return panel_sql(RENAME_SQL + f""", c AS (SELECT *, CASE WHEN {unclear} THEN 'unjudgeable' WHEN anns = 0 THEN 'anchor_missing' WHEN anns > 1 THEN 'anchor_conflict' WHEN ann > start_date THEN 'announced_after' WHEN ann < DATE '1996-01-01' OR ann >= DATE '2000-07-01' THEN 'out_of_period' END AS early
  FROM sp WHERE p_start IS NOT NULL AND (p_state = '{before}' AND state = '{after}' OR {unclear}))
SELECT sec, p_start AS prev_start, start_date, CASE WHEN anns = 1 THEN ann END AS ann_date, CASE WHEN star THEN 'starred' ELSE 'plain' END AS variant,
  coalesce(early, CASE WHEN (SELECT count(*) FROM c o WHERE o.early IS NULL AND o.sec = c.sec AND o.ann = c.ann) > 1 THEN 'duplicate_event_key' END, 'event') AS outcome FROM c""")


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = first_events(spark, sf_dir)
    day = F.day("anchor")
    one = F.when(F.col("layer") == "good", F.concat(F.lit("N"), "sec")).when(F.col("layer") == "bad", F.concat(F.lit("*ST "), "sec")).otherwise(F.concat(F.lit("ST"), "sec"))
    base = ev.select("sec", F.col("anchor").alias("start_date"), F.when(day % 5 != 0, F.date_sub("anchor", day % 4 - 1)).alias("ann_date"), one.alias("alias"))
    two = F.when(day % 2 == 0, F.concat(F.lit("ST "), "sec")).otherwise(F.concat("sec", F.lit("退")))
    return X.name_segments(base.unionByName(ev.filter(day % 6 == 1).select("sec", F.col("anchor").alias("start_date"), F.date_sub("anchor", 2).alias("ann_date"), two.alias("alias"))))


@query("r08_st_removal", change_sql("st", "normal"))
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.state_changes(renames(spark, sf_dir), "st", "normal", start="1996-01-01", end="2000-07-01")


@query("r09_st_imposition", change_sql("normal", "st"))
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.state_changes(renames(spark, sf_dir), "normal", "st", start="1996-01-01", end="2000-07-01")


@query("r16_imposition_routes", f"WITH q AS ({change_sql('normal', 'st')}) SELECT variant, count(*) AS events, count(DISTINCT sec) AS secs, min(ann_date) AS first_day, max(ann_date) AS last_day FROM q WHERE outcome = 'event' GROUP BY variant")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of R09 by the kind of mark, as they are handed on."""
    x = X.state_changes(renames(spark, sf_dir), "normal", "st", start="1996-01-01", end="2000-07-01").filter("outcome = 'event'")
    return x.groupBy("variant").agg(F.count("*").alias("events"), F.count_distinct("sec").alias("secs"), F.min("ann_date").alias("first_day"), F.max("ann_date").alias("last_day"))


@query("r08_star_changes", panel_sql(RENAME_SQL + " SELECT count(*) FILTER (p_state = 'st' AND state = 'st' AND p_star AND NOT star) AS destar, count(*) FILTER (p_state = 'st' AND state = 'st' AND NOT p_star AND star) AS star_on, count(*) FILTER (p_state = 'st' AND state = 'delist') AS st_to_delist, count(*) AS changes FROM sp WHERE p_start IS NOT NULL"))
def r08_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.star_changes(renames(spark, sf_dir))


@query("r13_index_spillover", panel_sql("""i AS (SELECT d, CAST(sum(amount) AS DOUBLE) AS c FROM bars GROUP BY d), t AS (SELECT d, c / lag(c) OVER (ORDER BY d) - 1 AS ret FROM i),
u AS (SELECT ret, (SELECT min(cal.d) FROM cal WHERE cal.d >= t.d + INTERVAL 1 DAY) AS nd FROM t WHERE abs(ret) >= 0.4),
k AS (SELECT nd AS d, min(ret) AS ret FROM u WHERE nd IS NOT NULL GROUP BY nd HAVING count(*) = 1),
m AS (SELECT sec, min(d) AS in_date, max(d) AS out_date FROM bars GROUP BY sec, year(d))
SELECT k.d, sec, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS direction FROM k JOIN m ON k.d >= in_date AND k.d < out_date"""))
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    index = b.groupBy("d").agg(F.sum("amount").cast("double").alias("c"))
    members = b.groupBy("sec", F.year("d").alias("y0")).agg(F.min("d").alias("in_date"), F.max("d").alias("out_date")).drop("y0")
    return X.trigger_days(index, calendar(spark, sf_dir), members, least=0.4)


# Orders are rows of a customer group's annual distributions.

DIV_SQL = """b AS (SELECT 'S' || (o_custkey % 300) AS sec, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k FROM orders),
x AS (SELECT sec, k, CASE WHEN k % 10 <> 3 THEN make_date(year(day), 12, 31) ELSE day END AS end_date, make_date(year(day) + 1, 3, 1) + CAST(k % 40 AS INTEGER) AS ann, CASE WHEN k % 4 = 0 THEN '预案' ELSE '实施' END AS proc, CASE WHEN k // 4 % 2 = 0 THEN '0' ELSE '1' END AS flag, CASE WHEN k % 7 <> 0 THEN CAST(k % 5 AS DECIMAL(10,2)) END AS v FROM b),
g AS (SELECT sec, end_date, count(*) FILTER (proc = '预案' AND flag = '0') AS n, count(DISTINCT (ann, coalesce(v, -9))) FILTER (proc = '预案' AND flag = '0') AS kinds, min(ann) FILTER (proc = '预案' AND flag = '0') AS ann_date, min(v) FILTER (proc = '预案' AND flag = '0') AS v
  FROM x WHERE strftime(end_date, '%m%d') = '1231' AND ann < DATE '2001-03-20' GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN n = 0 THEN 'initial_missing' WHEN n > 1 AND kinds > 1 THEN 'initial_multiple_conflict' WHEN n > 1 THEN 'initial_multiple_identical' WHEN v IS NULL THEN 'initial_required_invalid' END AS bad FROM g),
o AS (SELECT q.sec, q.end_date, q.ann_date, CASE WHEN q.bad IS NOT NULL THEN q.bad WHEN q.ann_date < DATE '1997-01-01' THEN 'before_period' WHEN p.sec IS NULL THEN 'missing_prior' WHEN p.bad IS NOT NULL THEN 'unresolvable_prior' WHEN p.v = 0 THEN 'zero_undefined'
  WHEN q.v / p.v - 1 >= 0.5 THEN 'up' WHEN q.v / p.v - 1 <= -0.5 THEN 'down' ELSE 'inside' END AS o FROM q LEFT JOIN q p ON p.sec = q.sec AND year(p.end_date) = year(q.end_date) - 1)"""


@query("r11_dividend_surprise", f"WITH {DIV_SQL} SELECT sec, end_date, ann_date, CASE WHEN o IN ('up', 'down') AND (SELECT count(*) FROM o z WHERE z.sec = o.sec AND z.ann_date = o.ann_date AND z.o IN ('up', 'down')) > 1 THEN 'duplicate_event_key' ELSE o END AS outcome FROM o")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    rows = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey") % 300).alias("sec"), F.when(k % 10 != 3, F.make_date(y, F.lit(12), F.lit(31))).otherwise(F.to_date("o_orderdate")).alias("end_date"), F.date_add(F.make_date(y + 1, F.lit(3), F.lit(1)), (k % 40).cast("int")).alias("ann_date"),
        F.when(k % 4 == 0, "预案").otherwise("实施").alias("div_proc"), F.when(F.floor(k / 4) % 2 == 0, "0").otherwise("1").alias("update_flag"), F.when(k % 7 != 0, (k % 5).cast("decimal(10,2)")).alias("cash"),
        F.lit(None).cast("date").alias("base_date"), F.lit(None).cast("double").alias("base_share"),
    )
    return X.dividend_surprise(rows, start="1997-01-01", end="2001-03-20")


# Even orders are quick reports, odd ones forecasts, of a customer group for a quarter.

FLASH_SQL = """b AS (SELECT 'S' || (o_custkey % 120) AS sec, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS end_date, CAST(o_orderdate AS DATE) AS ann_date, o_orderkey AS k FROM orders),
e AS (SELECT sec, end_date, ann_date, CASE WHEN k % 3 = 0 THEN '0' ELSE '1' END AS flag, CASE WHEN k % 22 <> 0 THEN CAST(k % 9 AS DOUBLE) END AS v FROM b WHERE k % 2 = 0 AND ann_date >= DATE '1996-01-01' AND ann_date < DATE '2000-12-01'),
f AS (SELECT sec, end_date, ann_date, CASE WHEN k % 5 <> 0 THEN CAST(k % 4 AS DOUBLE) END AS lo, CASE WHEN k % 11 <> 0 THEN CAST(k % 4 + k % 3 - CASE WHEN k % 13 = 0 THEN 5 ELSE 0 END AS DOUBLE) END AS hi FROM b WHERE k % 2 = 1),
g AS (SELECT sec, end_date, count(*) FILTER (flag = '0') AS n, min(ann_date) FILTER (flag = '0') AS ann_date, min(v) FILTER (flag = '0') AS v FROM e GROUP BY 1, 2),
m AS (SELECT g.*, (SELECT count(*) FROM f WHERE f.sec = g.sec AND f.end_date = g.end_date) AS a, (SELECT count(*) FROM f WHERE f.sec = g.sec AND f.end_date = g.end_date AND f.ann_date < g.ann_date) AS p, (SELECT max(ann_date) FROM f WHERE f.sec = g.sec AND f.end_date = g.end_date AND f.ann_date < g.ann_date AND lo <= hi) AS fd FROM g),
i AS (SELECT m.*, (SELECT count(DISTINCT (lo, hi)) FROM f WHERE f.sec = m.sec AND f.end_date = m.end_date AND f.ann_date = fd AND lo <= hi) AS kinds, (SELECT min(lo) FROM f WHERE f.sec = m.sec AND f.end_date = m.end_date AND f.ann_date = fd AND lo <= hi) AS lo, (SELECT min(hi) FROM f WHERE f.sec = m.sec AND f.end_date = m.end_date AND f.ann_date = fd AND lo <= hi) AS hi FROM m),
o AS (SELECT *, CASE WHEN n = 0 THEN 'flag0_missing' WHEN n > 1 THEN 'flag0_multiple' WHEN a = 0 THEN 'orphan' WHEN p = 0 THEN 'no_strict_prior' WHEN fd IS NULL THEN 'no_complete_prior' WHEN kinds > 1 THEN 'forecast_conflict' WHEN v IS NULL THEN 'actual_null' WHEN v > hi THEN 'up' WHEN v < lo THEN 'down' WHEN v = hi OR v = lo THEN 'boundary' ELSE 'inside' END AS o FROM i)"""


@query("r12_flash_gap", f"WITH {FLASH_SQL} SELECT sec, end_date, CASE WHEN n = 1 THEN ann_date END AS ann_date, CASE WHEN n = 1 AND kinds = 1 THEN fd END AS forecast_date, CASE WHEN o IN ('up', 'down') AND (SELECT count(*) FROM o z WHERE z.sec = o.sec AND z.ann_date = o.ann_date AND z.o IN ('up', 'down')) > 1 THEN 'duplicate_event_key' ELSE o END AS outcome FROM o")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    b = read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 120).alias("sec"), F.trunc(day, "quarter").alias("end_date"), day.alias("ann_date"), k)
    express = b.filter(k % 2 == 0).select("sec", "end_date", "ann_date", F.when(k % 3 == 0, "0").otherwise("1").alias("update_flag"), F.when(k % 22 != 0, (k % 9).cast("double")).alias("v"))
    hi = k % 4 + k % 3 - F.when(k % 13 == 0, 5).otherwise(0)
    forecasts = b.filter(k % 2 == 1).select("sec", "end_date", "ann_date", F.when(k % 5 != 0, (k % 4).cast("double")).alias("lo"), F.when(k % 11 != 0, hi.cast("double")).alias("hi"))
    return X.flash_gap(express, forecasts, start="1996-01-01", end="2000-12-01")


@query("r05_pullback_events", "WITH q AS (" + ORACLES["r05_high_pullback"] + """), e AS (SELECT * FROM q WHERE outcome = 'EVENT') SELECT sec, anchor_d, d, CASE WHEN (SELECT count(*) FROM e z WHERE z.sec = e.sec AND z.d = e.d) > 1 THEN 'duplicate_event_key' WHEN d < DATE '1996-06-01' THEN 'before_range' WHEN d >= DATE '2000-06-01' THEN 'after_range' ELSE 'event' END AS outcome FROM e""")
def r05_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pullback_events(r05(spark, sf_dir), start="1996-06-01", end="2000-06-01")
