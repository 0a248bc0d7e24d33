"""Queries of the smaller constructs: lookups, profiles, folds, JSON paths, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import returns as R
from eventide.registry import query
from eventide.sources.panel import DENSE, bars, calendar, first_events, panel_sql, read


@query("s15_keyed_lookup", panel_sql("SELECT event_id, close FROM ev JOIN bars b ON b.sec = ev.sec AND b.d = anchor"))
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_events(spark, sf_dir).join(bars(spark, sf_dir).select("sec", F.col("d").alias("anchor"), "close"), ["sec", "anchor"]).select("event_id", "close")


@query("s18_calendar_with_previous", "SELECT d, lag(d) OVER (ORDER BY d) AS pretrade_date FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem UNION SELECT CAST(o_orderdate AS DATE) FROM orders)")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    days = a.union(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate"))).distinct()
    return days.withColumn("pretrade_date", F.lag("d").over(Window.orderBy("d")))


@query("j01_adjusted_prices", panel_sql("""f AS (SELECT sec, d, CAST(1 + (vol % 7) * 0.1 AS DECIMAL(4,1)) AS adj_factor FROM bars WHERE vol % 5 <> 0)
SELECT b.sec, b.d, CAST(close * adj_factor AS DECIMAL(24,5)) AS adj_close, CAST(open * adj_factor AS DECIMAL(24,5)) AS adj_open FROM bars b JOIN f USING (sec, d)"""))
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    f = b.filter("vol % 5 <> 0").select("sec", "d", (1 + (F.col("vol") % 7) * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(4,1)").alias("adj_factor"))
    x = b.join(f, ["sec", "d"])
    return x.select("sec", "d", *((F.col(c) * F.col("adj_factor")).cast("decimal(24,5)").alias(f"adj_{c}") for c in ("close", "open")))


@query("j09_prior_denominator", panel_sql("""q AS (SELECT sec, date_trunc('quarter', d) AS qd, sum(amount) AS eq, count(*) % 2 AS ver FROM bars GROUP BY 1, 2)
SELECT event_id, max_by(eq, qd) AS denominator, max(qd)::DATE AS quarter FROM ev JOIN q ON q.sec = ev.sec AND q.qd + INTERVAL 3 MONTH <= anchor GROUP BY event_id"""))
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bars(spark, sf_dir).groupBy("sec", F.trunc("d", "quarter").alias("quarter")).agg(F.sum("amount").alias("denominator"))
    # a quarter is known from the next one on, and events are in quarters: the latest known is found by a window, not by pairs
    known = q.select("sec", F.add_months("quarter", 3).alias("t"), F.struct("quarter", "denominator").alias("x"), F.lit(None).cast("string").alias("event_id"), F.lit(0).alias("o"))
    ev = first_events(spark, sf_dir).select("sec", F.col("anchor").alias("t"), F.lit(None).cast(known.schema["x"].dataType).alias("x"), "event_id", F.lit(1).alias("o"))
    w = Window.partitionBy("sec").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(ev).withColumn("last", F.last("x", ignorenulls=True).over(w)).filter("o = 1 and last is not null")
    return both.select("event_id", F.col("last.denominator").alias("denominator"), F.col("last.quarter").alias("quarter"))


@query("j11_previous_day_factor", panel_sql("""c AS (SELECT d, lag(d) OVER (ORDER BY d) AS pd FROM cal)
SELECT b.sec, b.d, CASE WHEN p.vol IS NULL THEN 'missing' WHEN p.vol = b.vol THEN 'unchanged' ELSE 'changed' END AS factor FROM bars b JOIN c USING (d) LEFT JOIN bars p ON p.sec = b.sec AND p.d = c.pd"""))
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "d")
    w = Window.partitionBy("sec").orderBy("cal_idx")
    prev = F.when(F.lag("cal_idx").over(w) == F.col("cal_idx") - 1, F.lag("vol").over(w))
    return b.select("sec", "d", F.when(prev.isNull(), "missing").when(prev == F.col("vol"), "unchanged").otherwise("changed").alias("factor"))


@query("j18_listing_attribution", """WITH l AS (SELECT o_custkey, o_orderpriority AS code, min(o_orderdate) AS list_date, max(o_orderdate) AS delist_date FROM orders GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN count(code) = 1 THEN min(code) END AS code, count(code) AS hits FROM orders o LEFT JOIN l ON l.o_custkey = o.o_custkey AND o.o_orderdate >= list_date AND o.o_orderdate < delist_date GROUP BY o_orderkey""")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    l = o.groupBy("o_custkey", F.col("o_orderpriority").alias("code")).agg(F.min("o_orderdate").alias("list_date"), F.max("o_orderdate").alias("delist_date"))
    x = o.join(l.groupBy("o_custkey").agg(F.collect_list(F.struct("code", "list_date", "delist_date")).alias("all")), "o_custkey", "left")  # at most five codes a customer
    hit = F.filter("all", lambda s: (F.col("o_orderdate") >= s["list_date"]) & (F.col("o_orderdate") < s["delist_date"]))
    x = x.withColumn("hit", hit)
    return x.select("o_orderkey", F.when(F.size("hit") == 1, F.col("hit")[0]["code"]).alias("code"), F.size("hit").cast("long").alias("hits"))


@query("w11_decimal_sum", panel_sql("SELECT sec, d, s < 20 * close AS above FROM (SELECT sec, d, close, sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY sec ORDER BY d) AS n FROM bars) WHERE n >= 20"))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moving(bars(spark, sf_dir)).filter("own_idx >= 20").select("sec", "d", (F.col("sum20") < F.col("close") * 20).alias("above"))


@query("w17_recent_listing", panel_sql("SELECT sec, count(*) AS n, max(d) AS until FROM (SELECT sec, d, row_number() OVER (PARTITION BY sec ORDER BY d) AS n FROM bars) WHERE n <= 30 GROUP BY sec"))
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(R.by_sec())
    return bars(spark, sf_dir).withColumn("n", n).filter("n <= 30").groupBy("sec").agg(F.count("*").alias("n"), F.max("d").alias("until"))


@query("w23_holding_compounding", panel_sql("""r AS (SELECT sec, d, ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE)) AS ret FROM bars), m AS (SELECT d, avg(ret) AS rm FROM r WHERE ret IS NOT NULL GROUP BY d),
a AS (SELECT cal_idx, rm FROM cal LEFT JOIN m USING (d)), e AS (SELECT event_id, (SELECT min(cal_idx) FROM cal WHERE d > anchor) AS t FROM ev)
SELECT event_id, round(exp(sum(rm)) - 1, 8) AS held FROM e JOIN a ON cal_idx BETWEEN t AND t + 19 GROUP BY event_id HAVING count(rm) = 20"""))
def w23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.sources.readers import first_day_from

    cal = calendar(spark, sf_dir)
    m = cal.join(R.market_return(R.gap_returns(bars(spark, sf_dir))), "d", "left")
    # prefix sums over the bounded axis: a window's sum is a difference
    w = Window.orderBy("cal_idx").rowsBetween(0, 19)
    held = m.select("cal_idx", F.sum("ret_eqw").over(w).alias("s"), F.count("ret_eqw").over(w).alias("n"))
    ev = first_day_from(first_events(spark, sf_dir).withColumn("t", F.date_add("anchor", 1)), cal, "t")
    return ev.join(F.broadcast(held.filter("n = 20")), "cal_idx").select("event_id", F.round(F.exp("s") - 1, 8).alias("held"))


@query("a20_five_numbers", panel_sql("SELECT sec, min(close) AS lo, round(avg(CAST(close AS DOUBLE)), 6) AS mean, median(CAST(close AS DOUBLE)) AS med, max(close) AS hi, count(*) AS n FROM bars GROUP BY sec"))
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("close").cast("double")
    return bars(spark, sf_dir).groupBy("sec").agg(F.min("close").alias("lo"), F.round(F.avg(x), 6).alias("mean"), F.median(x).alias("med"), F.max("close").alias("hi"), F.count("*").alias("n"))


@query("a29_coverage", panel_sql("SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT sec, count(*) AS n FROM bars GROUP BY sec)"))
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("sec").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("a31_source_profile", """SELECT year(o_orderdate) AS y, count(*) AS n, count(*) - count(DISTINCT (o_custkey, CAST(o_orderdate AS DATE))) AS dup_keys, count(*) FILTER (o_totalprice IS NULL) AS null_price, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("o_custkey", "day")).alias("dup_keys"), F.count_if(F.col("o_totalprice").isNull()).alias("null_price"), F.count_if(F.col("o_totalprice") > 200000).alias("large")
    )


@query("k06_json_extract", "SELECT concat_ws('|', event_id, event_type, json_extract_string(props, '$.k')) AS line FROM events")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.get_json_object("props", "$.k")).alias("line"))


@query("t06_earliest_same_day", "SELECT event_id FROM (SELECT event_id, CAST(ts AS DATE) AS day, min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS first FROM events) WHERE day = first")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.withColumn("first", F.min("day").over(Window.partitionBy("user_id"))).filter("day = first").select("event_id")
