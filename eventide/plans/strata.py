"""Queries that take a study apart: benchmarks, signs, windows, strata, censoring, entries and exits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import returns as R
from eventide.operators import study as E
from eventide.plans.market import LIQUID
from eventide.plans.study import BASE, GRP, LENGTH, Study, r9, sql
from eventide.registry import keep, query
from eventide.sources import readers
from eventide.sources.panel import DENSE, bars, calendar, first_events, industry, panel_sql

MARKET = "m AS (SELECT cal_idx, avg(r) AS rm FROM r WHERE r IS NOT NULL GROUP BY cal_idx)"
CARS = "ca AS (SELECT event_id, layer, sum(ar) AS car, sum(sar) AS csar FROM sa GROUP BY 1, 2 HAVING count(ar) = 20)"
#: The securities of the static pool.
STATIC = ["STANDARD POLISHED TIN", "ECONOMY PLATED COPPER", "PROMO BURNISHED NICKEL", "SMALL BRUSHED STEEL", "MEDIUM ANODIZED BRASS"]


def benchmark_sql(market: str, before: str = "") -> str:
    assert MARKET in BASE
    return panel_sql(before + BASE.replace(MARKET, market) + " SELECT count(*) AS n, round(sum(aar), 9) AS caar FROM (SELECT tau, avg(ar) AS aar FROM ab GROUP BY tau)", DENSE)


def caar(ab: DataFrame) -> DataFrame:
    return ab.groupBy("tau").agg(F.avg("ar").alias("aar")).agg(F.count("*").alias("n"), F.round(F.sum("aar"), 9).alias("caar"))


@query("e08_benchmark_market", benchmark_sql(MARKET))
def e08_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caar(Study(spark, sf_dir).ab)


@query("e08_benchmark_pool_pit", benchmark_sql("m AS (SELECT r.cal_idx, avg(r) AS rm FROM r JOIN cal USING (cal_idx) JOIN pool USING (d, sec) WHERE r IS NOT NULL GROUP BY 1)", LIQUID + ", "))
def e08_pool_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caar(Study(spark, sf_dir, benchmark="pool_pit").ab)


@query("e08_benchmark_pool", benchmark_sql(f"m AS (SELECT cal_idx, avg(r) AS rm FROM r WHERE r IS NOT NULL AND sec IN {tuple(STATIC)} GROUP BY 1)"))
def e08_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caar(Study(spark, sf_dir, benchmark="pool", members=STATIC).ab)


@query("e03_st_on_anchor", panel_sql("""b AS (SELECT sec, cal_idx, vol FROM bars JOIN cal USING (d)),
e0 AS (SELECT *, (SELECT max(cal_idx) FROM cal WHERE d <= anchor) AS t, (SELECT max(cal_idx) FROM cal) AS last_idx FROM ev),
e1 AS (SELECT *, (SELECT min(cal_idx) FROM b WHERE b.sec = e0.sec AND cal_idx BETWEEN t AND t + 5) AS tau0, EXISTS (SELECT 1 FROM b WHERE b.sec = e0.sec AND cal_idx = t AND vol % 7 = 0) AS st FROM e0)
SELECT event_id, tau0, CASE WHEN t IS NULL OR t < 250 THEN 'history' WHEN st THEN 'st' WHEN tau0 IS NULL AND t + 5 > last_idx THEN 'history' WHEN tau0 IS NULL THEN 'postpone' END AS reject_reason FROM e1"""))
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a security under special treatment (here: days whose volume 7 divides) go; the anchor itself may be tau0."""
    cal = keep(calendar(spark, sf_dir))
    b = keep(bars(spark, sf_dir).join(F.broadcast(cal), "d"))
    ev = readers.last_day_upto(first_events(spark, sf_dir), cal, "anchor").withColumnRenamed("cal_idx", "anchor_idx")
    return E.clean(ev, b, cal, st=b.filter("vol % 7 = 0").select("sec", "cal_idx"), tau0_on_anchor=True).select("event_id", "tau0", "reject_reason")


ST_MODE_SQL = """b AS (SELECT sec, d, cal_idx, vol % 3 = 0 AS st FROM bars JOIN cal USING (d)), r0 AS (SELECT sec, arg_min(st, d) AS st FROM b GROUP BY sec),
e0 AS (SELECT *, (SELECT max(cal_idx) FROM cal WHERE d <= anchor) AS t, (SELECT max(cal_idx) FROM cal) AS last_idx FROM ev),
e1 AS (SELECT e0.*, (SELECT min(cal_idx) FROM b WHERE b.sec = e0.sec AND cal_idx BETWEEN t + 1 AND t + 6) AS tau0, {st} AS st FROM e0)
SELECT event_id, st AS is_st, tau0, CASE WHEN t IS NULL OR t < 250 THEN 'history' {why} WHEN tau0 IS NULL AND t + 6 > last_idx THEN 'history' WHEN tau0 IS NULL THEN 'postpone' END AS reject_reason FROM e1"""


def st_mode(mode: str, policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cal = keep(calendar(spark, sf_dir))
        b = keep(bars(spark, sf_dir).join(F.broadcast(cal), "d").withColumn("st", F.col("vol") % 3 == 0))
        ev = readers.last_day_upto(first_events(spark, sf_dir), cal, "anchor").withColumnRenamed("cal_idx", "anchor_idx")
        return E.clean(ev, b, cal, st=E.st_days(b, mode), st_policy=policy).select("event_id", "is_st", "tau0", "reject_reason")

    return run


query("e03_st_kept", panel_sql(ST_MODE_SQL.format(st="EXISTS (SELECT 1 FROM b WHERE b.sec = e0.sec AND cal_idx = t AND b.st)", why="")))(st_mode("event_day", "keep"))
query("e03_st_of_first_row", panel_sql(ST_MODE_SQL.format(st="coalesce((SELECT st FROM r0 WHERE r0.sec = e0.sec), false)", why="WHEN st THEN 'st'")))(st_mode("legacy_row0", "reject"))


@query("e09_signed_caar", sql("SELECT tau, round(avg(ar), 9) AS raw_aar, round(avg(CASE WHEN layer = 'bad' THEN -ar ELSE ar END), 9) AS signed_aar FROM ab GROUP BY tau"))
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    signed = E.abnormal(s.kept, s.returns, s.market, length=LENGTH, sign=F.when(F.col("layer") == "bad", -1).otherwise(1))
    both = s.ab.select("event_id", "tau", F.col("ar").alias("raw")).join(signed.select("event_id", "tau", "ar"), ["event_id", "tau"])
    return both.groupBy("tau").agg(F.round(F.avg("raw"), 9).alias("raw_aar"), F.round(F.avg("ar"), 9).alias("signed_aar"))


@query("e18_secondary_windows", sql("""w AS (SELECT len, event_id, sum(ar) AS car, sum(sar) AS csar FROM sa JOIN (SELECT unnest([3, 5, 10]) AS len) ON tau < len GROUP BY 1, 2 HAVING count(ar) = len)
SELECT len, count(*) AS n, round(avg(car), 9) AS mean_car, round(avg(csar) / stddev_samp(csar) * sqrt(count(csar)), 8) AS bmp_car FROM w GROUP BY len"""))
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    # one pass: a day counts for every window that is longer than its tau
    days = s.ab.withColumn("len", F.explode(F.filter(F.array(*map(F.lit, (3, 5, 10))), lambda n: n > F.col("tau"))))
    cars = days.groupBy("len", "event_id").agg(F.sum("ar").alias("car"), F.sum("sar").alias("csar"), F.count("ar").alias("k")).filter("k = len")
    return cars.groupBy("len").agg(F.count("*").alias("n"), F.round(F.avg("car"), 9).alias("mean_car"), F.round(E.t_of("csar"), 8).alias("bmp_car"))


@query("a19_summary", sql(CARS + " SELECT count(*) AS n, round(avg(car), 9) AS mean, round(median(car), 9) AS median, round(avg(CAST(car > 0 AS INTEGER)), 9) AS pos_frac, round(stddev_samp(car), 9) AS std FROM ca"))
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.car(Study(spark, sf_dir).ab, length=LENGTH)
    return c.agg(
        F.count("*").alias("n"), F.round(F.avg("car"), 9).alias("mean"), F.round(F.median("car"), 9).alias("median"),
        F.round(F.avg((F.col("car") > 0).cast("int")), 9).alias("pos_frac"), F.round(F.stddev_samp("car"), 9).alias("std"),
    )


@query("a10_layer_tests", sql(CARS + f""", rr AS (SELECT res.event_id, cal_idx, e, layer, {GRP} AS grp FROM res JOIN kept USING (event_id)),
pr AS (SELECT a.layer, a.event_id AS a, b.event_id AS b, corr(a.e, b.e) AS rho FROM rr a JOIN rr b ON a.layer = b.layer AND a.grp = b.grp AND a.cal_idx = b.cal_idx AND a.event_id < b.event_id GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND var_pop(a.e) > 0 AND var_pop(b.e) > 0),
rl AS (SELECT layer, avg(rho) AS rho, count(*) AS n_pairs FROM pr GROUP BY layer), aa AS (SELECT layer, sum(aar) AS caar FROM (SELECT layer, tau, avg(ar) AS aar FROM sa GROUP BY 1, 2) GROUP BY layer)
SELECT l.layer, count(ca.event_id) AS n, round(any_value(caar), 9) AS caar, round(avg(car), 9) AS mean_car, round(avg(car) / stddev_samp(car) * sqrt(count(car)), 8) AS naive_t, round(avg(csar) / stddev_samp(csar) * sqrt(count(csar)), 8) AS bmp_car,
  round(avg(csar) / stddev_samp(csar) * sqrt(count(csar)) * sqrt((1 - coalesce(any_value(rho), 0)) / (1 + (count(csar) - 1) * coalesce(any_value(rho), 0))), 7) AS adj_bmp, coalesce(any_value(n_pairs), 0) AS n_pairs,
  CASE WHEN count(ca.event_id) = 0 THEN 'no_survivors' WHEN count(ca.event_id) < 30 THEN 'insufficient' ELSE 'tested' END AS status
FROM (SELECT DISTINCT layer FROM e2) l LEFT JOIN ca ON ca.layer = l.layer LEFT JOIN rl ON rl.layer = l.layer LEFT JOIN aa ON aa.layer = l.layer GROUP BY l.layer"""))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole suite for each layer, with the layer's own correlation; one that no event survives keeps its row and says so."""
    s = Study(spark, sf_dir)
    c = E.car(s.ab, length=LENGTH).join(s.kept.select("event_id", "layer"), "event_id")
    groups = s.kept.select("event_id", F.concat_ws("|", "layer", industry(F.col("sec"))).alias("grp"))
    sums = E.rho_sums(s.est.join(s.kept.select("event_id"), "event_id", "left_semi"), s.fit, groups)
    rho = sums.groupBy(F.split_part("grp", F.lit("|"), F.lit(1)).alias("layer")).agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("rho"), F.sum("n").alias("n_pairs"))
    aar = s.ab.groupBy("layer", "tau").agg(F.avg("ar").alias("aar")).groupBy("layer").agg(F.sum("aar").alias("caar"))
    n = F.count("event_id")
    tests = s.cleaned.select("layer").distinct().join(c, "layer", "left").groupBy("layer").agg(n.alias("n"), F.avg("car").alias("mean_car"), E.t_of("car").alias("naive_t"), E.t_of("csar").alias("bmp_car"))
    x = tests.join(rho, "layer", "left").join(aar, "layer", "left")
    factor = E.kp_factor(F.coalesce("rho", F.lit(0.0)), F.col("n"))
    return x.select(
        "layer", "n", *r9("caar", "mean_car"), F.round("naive_t", 8).alias("naive_t"), F.round("bmp_car", 8).alias("bmp_car"), F.round(F.when(F.col("bmp_car").isNotNull(), F.col("bmp_car") * factor), 7).alias("adj_bmp"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        F.when(F.col("n") == 0, "no_survivors").when(F.col("n") < 30, "insufficient").otherwise("tested").alias("status"),
    )


@query("a22_rejections_by_layer_year", sql("SELECT layer, year(anchor) AS year, coalesce(reason, 'valid') AS outcome, count(*) AS n FROM fin GROUP BY 1, 2, 3"))
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Study(spark, sf_dir).final
    return f.groupBy("layer", F.year("anchor").cast("long").alias("year"), F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


BOARD_SQL = "['main', 'chinext', 'star', 'bse'][ascii(right(sec, 1)) % 4 + 1]"
ST_SQL = "day(anchor) % 5 = 0"


def boards(sec: str = "sec"):
    """Securities dealt to boards by their last letter."""
    return F.element_at(F.array(*map(F.lit, ("main", "chinext", "star", "bse"))), F.ascii(F.right(sec, F.lit(1))) % 4 + 1)


@query("a23_strata", sql(f"SELECT CASE WHEN {ST_SQL} THEN 'ST' ELSE {BOARD_SQL} END AS stratum, count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS rejected, round(count(reason) / count(*), 9) AS reject_ratio FROM fin GROUP BY 1"))
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, st = F.count("reject_reason"), F.day("anchor") % 5 == 0
    return Study(spark, sf_dir).final.groupBy(F.when(st, "ST").otherwise(boards()).alias("stratum")).agg(
        F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("valid"), n.alias("rejected"), F.round(n / F.count("*"), 9).alias("reject_ratio")
    )


@query("a23_chinext_regimes", sql(f"SELECT CASE WHEN anchor + INTERVAL 24 YEAR < DATE '2020-08-24' THEN 'pre_10pct' ELSE 'post_20pct' END AS segment, count(*) AS valid FROM kept WHERE {BOARD_SQL} = 'chinext' GROUP BY 1"))
def a23_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Study(spark, sf_dir).kept.filter(boards() == "chinext")
    return kept.groupBy(S.regime_segment(F.add_months("anchor", 288)).alias("segment")).agg(F.count("*").alias("valid"))


@query("a25_censor_panel_strata", sql(f"""x AS (SELECT {BOARD_SQL.replace('sec', 'sa.sec')} AS board, tau, ar, sar, CASE WHEN b.sec IS NULL THEN 'suspend' WHEN open = close AND high = low THEN 'one_word' WHEN vol % 17 = 0 THEN 'limit_up' WHEN vol % 19 = 0 THEN 'limit_down' ELSE 'none' END AS flag
  FROM sa JOIN cal ON cal.cal_idx = sa.idx LEFT JOIN bars b ON b.sec = sa.sec AND b.d = cal.d)
SELECT board, tau, count(*) AS n, count(*) FILTER (flag = 'suspend') AS suspend, count(*) FILTER (flag = 'one_word') AS one_word, count(*) FILTER (flag = 'limit_up') AS limit_up, count(*) FILTER (flag = 'limit_down') AS limit_down,
  round(count(*) FILTER (flag <> 'none') / count(*), 9) AS censored, round(avg(ar), 9) AS aar, CASE WHEN stddev_samp(sar) > 0 THEN round(avg(sar) / stddev_samp(sar) * sqrt(count(sar)), 7) END AS bmp FROM x WHERE tau < 6 GROUP BY 1, 2"""))
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a day's return from being traded, and the tests of the day, by board."""
    s = Study(spark, sf_dir)
    flag = F.when(F.col("one_word"), "one_word").when(F.col("vol") % 17 == 0, "limit_up").when(F.col("vol") % 19 == 0, "limit_down").otherwise("none")
    x = s.ab.filter("tau < 6").join(s.bars.select("sec", "cal_idx", flag.alias("flag")), ["sec", "cal_idx"], "left").withColumn("flag", F.coalesce("flag", F.lit("suspend")))
    kinds = [F.count_if(F.col("flag") == k).alias(k) for k in ("suspend", "one_word", "limit_up", "limit_down")]
    return x.groupBy(boards().alias("board"), "tau").agg(
        F.count("*").alias("n"), *kinds, F.round(F.count_if(F.col("flag") != "none") / F.count("*"), 9).alias("censored"), F.round(F.avg("ar"), 9).alias("aar"), F.round(E.t_of("sar"), 7).alias("bmp")
    )


@query("a35_merged_counters", sql("SELECT coalesce(early, 'open') AS counter, count(*) AS n, count(DISTINCT sec) AS n_secs FROM e2 GROUP BY 1"))
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each security, merged by their sums."""
    own = Study(spark, sf_dir).cleaned.groupBy("sec", F.coalesce("reject_reason", F.lit("open")).alias("counter")).agg(F.count("*").alias("n"))
    return own.groupBy("counter").agg(F.sum("n").alias("n"), F.count("*").alias("n_secs"))


@query("e11_entry_exit", sql("""SELECT event_id, a.open AS entry, b.close AS exit, CASE WHEN b.close IS NULL THEN 'suspended' WHEN b.high = b.low AND b.open = b.close THEN 'one_word' ELSE 'traded' END AS exit_status,
  round(CAST(b.close AS DOUBLE) / CAST(a.open AS DOUBLE) - 1, 9) AS gross
FROM kept k JOIN cal ca ON ca.cal_idx = k.tau0 JOIN bars a ON a.sec = k.sec AND a.d = ca.d JOIN cal cb ON cb.cal_idx = k.tau0 + 19 LEFT JOIN bars b ON b.sec = k.sec AND b.d = cb.d"""))
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open on tau0, and what the last day of the window allows."""
    s = Study(spark, sf_dir)
    first = s.bars.select("sec", F.col("cal_idx").alias("tau0"), F.col("open").alias("entry"))
    flat = (F.col("high") == F.col("low")) & (F.col("open") == F.col("close"))
    last = s.bars.select("sec", (F.col("cal_idx") - LENGTH + 1).alias("tau0"), F.col("close").alias("exit"), flat.alias("flat"))
    x = s.kept.select("event_id", "sec", "tau0").join(first, ["sec", "tau0"]).join(last, ["sec", "tau0"], "left")
    status = F.when(F.col("exit").isNull(), "suspended").when(F.col("flat"), "one_word").otherwise("traded")
    return x.select("event_id", "entry", "exit", status.alias("exit_status"), F.round(F.col("exit").cast("double") / F.col("entry").cast("double") - 1, 9).alias("gross"))


@query("e21_sellability", panel_sql("""p AS (SELECT *, lag(close) OVER (PARTITION BY sec ORDER BY d) AS prev FROM bars), l AS (SELECT *, round(prev * 0.90, 2) AS down, round(prev * 1.10, 2) AS up, open = high AND high = low AND low = close AS flat FROM p)
SELECT sec, d, prev IS NULL OR NOT (close = down OR (flat AND close = up AND close < prev)) AS at_close, open > 0 AND (prev IS NULL OR open <> down) AS at_open FROM l"""))
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not sellable at a lower limit, nor in a one-word bar below the close before; at the open, not at its lower limit."""
    x = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(R.by_sec()))
    pct = F.lit("0.10").cast("decimal(4,2)")
    status = S.limit_status(*map(F.col, ("open", "high", "low", "close", "prev")), pct)
    down = (status == "limit_down") | ((status == "one_word") & (F.col("close") < F.col("prev")))
    return x.select("sec", "d", (~down).alias("at_close"), ((F.col("open") > 0) & (S.open_limit_status(F.col("open"), F.col("prev"), pct) != "limit_down")).alias("at_open"))


@query("j15_event_in_pool", panel_sql(LIQUID + """, e AS (SELECT event_id, sec, (SELECT min(d) FROM cal WHERE d > anchor) AS d FROM ev)
SELECT event_id, e.d, rank FROM e JOIN pool USING (sec, d)"""))
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose security is in the pool of the first open day after the anchor."""
    cal, b = keep(calendar(spark, sf_dir)), bars(spark, sf_dir)
    ev = readers.first_day_from(first_events(spark, sf_dir).withColumn("next", F.date_add("anchor", 1)), cal, "next")
    at = ev.join(F.broadcast(cal), "cal_idx").select("event_id", "sec", "d")
    return at.join(R.pool(b, cal).select("d", "sec", "rank"), ["sec", "d"]).select("event_id", "d", "rank")


@query("w15_calendar_runs", panel_sql("""x AS (SELECT sec, d, cal_idx, close < open AS down FROM bars JOIN cal USING (d)), y AS (SELECT sec, d, cal_idx - row_number() OVER (PARTITION BY sec ORDER BY d) AS g FROM x WHERE down)
SELECT sec, min(d) AS run_start, max(d) AS run_end, count(*) AS n FROM y GROUP BY sec, g"""))
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of falling bars, split where the calendar has an open day without a falling bar in between."""
    w = Window.partitionBy("sec").orderBy("cal_idx")
    x = bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "d").filter("close < open")
    x = x.withColumn("g", F.col("cal_idx") - F.row_number().over(w))
    return x.groupBy("sec", "g").agg(F.min("d").alias("run_start"), F.max("d").alias("run_end"), F.count("*").alias("n")).drop("g")


@query("t05_first_securities", panel_sql("SELECT sec, d, close FROM bars WHERE sec IN (SELECT DISTINCT sec FROM bars ORDER BY sec LIMIT 5)"))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the first five securities by code (a report's sample)."""
    b = bars(spark, sf_dir)
    return b.join(F.broadcast(b.select("sec").distinct().orderBy("sec").limit(5)), "sec", "left_semi").select("sec", "d", "close")
