"""Queries over bars: returns, benchmarks, pools, trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.operators import returns as R
from eventide.registry import query
from eventide.sources.panel import bars, calendar, panel_sql

LN = "ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE))"


@query("q01_market_eqw_return", panel_sql(f"""r AS (SELECT sec, d, {LN} AS ret FROM bars)
SELECT d, round(avg(ret), 9) AS ret_eqw, count(*) AS n_stocks FROM r WHERE ret IS NOT NULL GROUP BY d"""))
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.market_return(R.gap_returns(bars(spark, sf_dir)))
    return out.withColumn("ret_eqw", F.round("ret_eqw", 9))


@query("q01_market_of_all_parts", panel_sql(f"""r AS (SELECT sec, d, {LN} AS ret FROM bars)
SELECT d, round(avg(ret), 9) AS ret_eqw, count(*) AS n_stocks FROM r WHERE ret IS NOT NULL GROUP BY d""", "p_partkey"))
def q01_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market return over thousands of securities, one for each part."""
    return R.market_return(R.gap_returns(bars(spark, sf_dir, "p_partkey"))).withColumn("ret_eqw", F.round("ret_eqw", 9))


@query("w01_gap_return", panel_sql(f"SELECT sec, d, round({LN}, 9) AS ret FROM bars"))
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gap_returns(bars(spark, sf_dir)).select("sec", "d", F.round("ret", 9).alias("ret"))


@query("w02_open_gap_return", panel_sql("SELECT sec, d, round(ln(CAST(lead(open) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE)) - ln(CAST(open AS DOUBLE)), 9) AS ret FROM bars"))
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.open_gap_returns(bars(spark, sf_dir)).select("sec", "d", F.round("ret", 9).alias("ret"))


@query("w03_single_day_return", panel_sql("""a AS (SELECT sec, d, cal_idx, close FROM bars JOIN cal USING (d))
SELECT a.sec, a.d, round(ln(CAST(a.close AS DOUBLE)) - ln(CAST(b.close AS DOUBLE)), 9) AS ret
FROM a LEFT JOIN a b ON a.sec = b.sec AND b.cal_idx = a.cal_idx - 1"""))
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.single_day_returns(bars(spark, sf_dir), calendar(spark, sf_dir)).select("sec", "d", F.round("ret", 9).alias("ret"))


LIQUID = """axis AS (SELECT sec, c.d, c.cal_idx FROM (SELECT sec, min(d) AS ld FROM bars GROUP BY sec) f JOIN cal c ON c.d >= ld),
liq AS (SELECT axis.sec, axis.d, cal_idx, avg(CAST(amount AS DOUBLE)) OVER (PARTITION BY axis.sec ORDER BY cal_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS trail,
  row_number() OVER (PARTITION BY axis.sec ORDER BY cal_idx) AS listed FROM axis LEFT JOIN bars b ON b.sec = axis.sec AND b.d = axis.d),
ranked AS (SELECT d, sec, trail, row_number() OVER (PARTITION BY d ORDER BY round(trail, 4) DESC, sec) AS rank, count(*) OVER (PARTITION BY d) AS n FROM liq WHERE listed >= 120 AND trail IS NOT NULL),
pool AS (SELECT d, sec, trail, rank FROM ranked WHERE rank <= (n + 4) // 5)"""


@query("w07_trailing_amount", panel_sql(LIQUID + " SELECT sec, d, round(trail, 6) AS trail, listed FROM liq"))
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.liquidity(bars(spark, sf_dir), calendar(spark, sf_dir)).select("sec", "d", F.round("trail", 6).alias("trail"), "listed")


@query("t01_pool_membership", panel_sql(LIQUID + " SELECT d, sec, rank FROM pool"))
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pool(bars(spark, sf_dir), calendar(spark, sf_dir)).select("d", "sec", "rank")


@query("a04_pool_return", panel_sql(LIQUID + f""", r AS (SELECT sec, d, {LN} AS ret FROM bars)
SELECT r.d, round(avg(ret), 9) AS ret_pool_eqw, count(*) AS n_pool_stocks FROM r JOIN pool USING (d, sec) WHERE ret IS NOT NULL GROUP BY r.d"""))
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return R.pool_return(R.gap_returns(b), R.pool(b, calendar(spark, sf_dir))).withColumn("ret_pool_eqw", F.round("ret_pool_eqw", 9))


@query("a40_pool_sizes", panel_sql(LIQUID + " SELECT round(avg(n), 6) AS avg_size, min(n) AS min_size, max(n) AS max_size, count(*) AS days FROM (SELECT d, count(*) AS n FROM pool GROUP BY d)"))
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.pool(bars(spark, sf_dir), calendar(spark, sf_dir)).groupBy("d").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.count("*").alias("days"))


@query("w09_moving_windows", panel_sql("""SELECT sec, d,
  CASE WHEN row_number() OVER w >= 60 THEN max(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS high60,
  CASE WHEN row_number() OVER w >= 10 THEN sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END::DECIMAL(24,4) AS sum10,
  CASE WHEN row_number() OVER w >= 20 THEN sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END::DECIMAL(24,4) AS sum20,
  CASE WHEN row_number() OVER w > 250 THEN close > max(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) END AS new_high
FROM bars WINDOW w AS (PARTITION BY sec ORDER BY d)"""))
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moving(bars(spark, sf_dir)).select("sec", "d", "high60", "sum10", "sum20", "new_high")


@query("w12_prior_mean", panel_sql("""SELECT sec, d, round(CASE WHEN count(*) OVER w = 60 THEN CAST(sum(amount) OVER w AS DOUBLE) / 60 END, 6) AS ma
FROM bars WHERE amount > 0 WINDOW w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prior_mean(bars(spark, sf_dir)).select("sec", "d", F.round("ma", 6).alias("ma"))


@query("w06_average_rank", panel_sql(f"""r AS (SELECT sec, d, round({LN}, 3) AS ret FROM bars), k AS (SELECT * FROM r WHERE ret IS NOT NULL)
SELECT sec, d, rank() OVER (PARTITION BY sec ORDER BY ret) + (count(*) OVER (PARTITION BY sec, ret) - 1) / 2.0 AS rank FROM k"""))
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.gap_returns(bars(spark, sf_dir)).withColumn("ret", F.round("ret", 3)).filter("ret is not null")
    return r.select("sec", "d", R.average_rank(r, ["sec"], "ret").alias("rank"))


@query("w14_down_runs", panel_sql("""b AS (SELECT sec, d, cal_idx, coalesce(close < lag(close) OVER (PARTITION BY sec ORDER BY d), false) AS down FROM bars JOIN cal USING (d)),
g AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY d) - row_number() OVER (PARTITION BY sec, down ORDER BY d) AS grp FROM b)
SELECT sec, min(d) AS run_start, max(d) AS run_end, count(*) AS run_len, max(cal_idx) - min(cal_idx) + 1 = count(*) AS contiguous
FROM g WHERE down GROUP BY sec, grp HAVING count(*) >= 2"""))
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "d")
    runs = R.islands(b, F.col("close") < F.lag("close").over(Window.partitionBy("sec").orderBy("d")), "d").filter("run_len >= 2")
    return runs.select("sec", "run_start", "run_end", "run_len", (F.col("i1") - F.col("i0") + 1 == F.col("run_len")).alias("contiguous"))


@query("w13_simple_return_trigger", panel_sql("""m AS (SELECT d, avg(CAST(close AS DOUBLE)) AS c FROM bars GROUP BY d)
SELECT d, round(c / p - 1, 9) AS ret FROM (SELECT d, c, lag(c) OVER (ORDER BY d) AS p FROM m) WHERE abs(c / p - 1) >= 0.03"""))
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bars(spark, sf_dir).groupBy("d").agg(F.avg(F.col("close").cast("double")).alias("c"))
    ret = F.col("c") / F.lag("c").over(Window.orderBy("d")) - 1  # one row per day: a bounded axis
    return index.withColumn("ret", ret).filter("abs(ret) >= 0.03").select("d", F.round("ret", 9).alias("ret"))


@query("w19_year_end_days", panel_sql("""k AS (SELECT d, year(d) AS y, month(d) AS m, row_number() OVER (PARTITION BY year(d), month(d) ORDER BY d DESC) AS back, row_number() OVER (PARTITION BY year(d), month(d) ORDER BY d) AS fwd FROM cal),
dec AS (SELECT y, d FROM k WHERE m = 12 AND back <= 10), jan AS (SELECT y - 1 AS y, d AS jan_d FROM k WHERE m = 1 AND fwd = 1),
base AS (SELECT y, (SELECT max(d) FROM cal WHERE d < x.d0) AS base_d FROM (SELECT y, min(d) AS d0 FROM dec GROUP BY y) x)
SELECT dec.y AS year, dec.d AS d, base_d, jan_d FROM dec JOIN base USING (y) LEFT JOIN jan USING (y)"""))
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir).withColumns({"y": F.year("d"), "m": F.month("d"), "prev": F.lag("d").over(Window.orderBy("d"))})
    month = Window.partitionBy("y", "m")
    k = cal.withColumns({"back": F.row_number().over(month.orderBy(F.desc("d"))), "fwd": F.row_number().over(month.orderBy("d"))})
    dec = k.filter("m = 12 and back <= 10")
    base = dec.groupBy("y").agg(F.min_by("prev", "d").alias("base_d"))
    jan = k.filter("m = 1 and fwd = 1").select((F.col("y") - 1).alias("y"), F.col("d").alias("jan_d"))
    return dec.join(base.filter("base_d is not null"), "y").join(jan, "y", "left").select(F.col("y").alias("year"), "d", "base_d", "jan_d")
