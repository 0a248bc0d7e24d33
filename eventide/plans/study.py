"""Queries of the event study over the dense panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.operators import study as E
from eventide.registry import keep, own, query
from eventide.sources import readers
from eventide.sources.panel import DENSE, bars, calendar, first_events, industry, panel_sql

LENGTH = 20


def Study(spark: SparkSession, sf_dir: str, *, benchmark: str = "market", members: list[str] | None = None) -> E.Study:  # noqa: N802
    """The study of one scale factor's tables; what it writes stays until registry.close_all()."""
    spec = E.Spec(length=LENGTH, benchmark=benchmark, members=None if members is None else tuple(members))
    s = E.Study(bars(spark, sf_dir, DENSE), calendar(spark, sf_dir), first_events(spark, sf_dir, DENSE), spec)
    own(s.close)
    return s


def group():
    """What events correlate in: the industry."""
    return industry(F.col("sec"))


BASE = """r AS (SELECT sec, cal_idx, ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE)) AS r FROM bars JOIN cal USING (d)),
m AS (SELECT cal_idx, avg(r) AS rm FROM r WHERE r IS NOT NULL GROUP BY cal_idx),
e0 AS (SELECT *, (SELECT max(cal_idx) FROM cal WHERE d <= anchor) AS t FROM ev),
e1 AS (SELECT e0.*, (SELECT min(r.cal_idx) FROM r WHERE r.sec = e0.sec AND r.cal_idx BETWEEN e0.t + 1 AND e0.t + 6) AS tau0, (SELECT max(cal_idx) FROM cal) AS last_idx FROM e0),
e2 AS (SELECT *, CASE WHEN t IS NULL OR t < 250 THEN 'history' WHEN tau0 IS NULL AND t + 6 > last_idx THEN 'history' WHEN tau0 IS NULL THEN 'postpone' END AS early FROM e1),
est AS (SELECT event_id, r.cal_idx, r, rm FROM e2 JOIN r ON e2.sec = r.sec AND r.cal_idx BETWEEN t - 250 AND t - 91 JOIN m ON m.cal_idx = r.cal_idx WHERE early IS NULL AND r IS NOT NULL),
ols AS (SELECT event_id, (avg(r * rm) - avg(r) * avg(rm)) / (avg(rm * rm) - avg(rm) * avg(rm)) AS beta, avg(r) AS my, avg(rm) AS mx, count(*) AS delta FROM est GROUP BY event_id),
res AS (SELECT est.event_id, cal_idx, r - (my - beta * mx) - beta * rm AS e FROM est JOIN ols USING (event_id)),
xs AS (SELECT event_id, avg(rm) AS x_bar, sum(rm * rm) - avg(rm) * sum(rm) AS sxx FROM e2 JOIN m ON m.cal_idx BETWEEN t - 250 AND t - 91 WHERE early IS NULL GROUP BY event_id),
fit AS (SELECT ols.event_id, my - beta * mx AS alpha, beta, delta, (SELECT stddev_samp(e) FROM res WHERE res.event_id = ols.event_id) AS sd, x_bar, sxx FROM ols JOIN xs USING (event_id)),
fin AS (SELECT e2.*, alpha, beta, delta, sd, x_bar, sxx, coalesce(early, CASE WHEN coalesce(delta, 0) < 2 THEN 'ols_error' WHEN delta < 112 THEN 'coverage' WHEN tau0 + 19 > last_idx THEN 'history' END) AS reason FROM e2 LEFT JOIN fit USING (event_id)),
kept AS (SELECT * FROM fin WHERE reason IS NULL),
ab AS (SELECT k.*, tau, k.tau0 + tau AS idx, r - alpha - beta * rm AS ar, rm FROM kept k CROSS JOIN (SELECT unnest(range(20)) AS tau) LEFT JOIN r ON r.sec = k.sec AND r.cal_idx = k.tau0 + tau LEFT JOIN m ON m.cal_idx = k.tau0 + tau),
sa AS (SELECT *, ar / (sd * sqrt(1 + 1.0 / delta + (rm - x_bar) * (rm - x_bar) / sxx)) AS sar FROM ab)"""


def sql(rest: str) -> str:
    return panel_sql(BASE + (" " if rest.upper().startswith("SELECT") else ", ") + rest, DENSE)


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


@query("e01_cleaning_ladder", sql("SELECT event_id, layer, t AS anchor_idx, tau0, early AS reject_reason FROM e2"))
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).cleaned.select("event_id", "layer", "anchor_idx", "tau0", "reject_reason")


def policy_sql(policy: str) -> str:
    exact = policy in ("legacy", "unified")
    block = "" if policy == "missing_bar_only" else " AND NOT ow"
    day = {"legacy": "WHEN g0 OR (g1 AND t + 1 <= last_idx) THEN 'suspension'", "unified": "WHEN g0 THEN 'event_day_anomaly'"}.get(policy, "")
    return panel_sql(f"""b AS (SELECT sec, cal_idx, open = close AND high = low AS ow FROM bars JOIN cal USING (d)),
e0 AS (SELECT *, {'(SELECT cal_idx FROM cal WHERE d = anchor)' if exact else '(SELECT max(cal_idx) FROM cal WHERE d <= anchor)'} AS t, (SELECT max(cal_idx) FROM cal) AS last_idx FROM ev),
e1 AS (SELECT *, (SELECT min(cal_idx) FROM b WHERE b.sec = e0.sec AND cal_idx BETWEEN t + 1 AND t + 6{block}) AS tau0, NOT EXISTS (SELECT 1 FROM b WHERE b.sec = e0.sec AND cal_idx = t) AS g0, NOT EXISTS (SELECT 1 FROM b WHERE b.sec = e0.sec AND cal_idx = t + 1) AS g1 FROM e0)
SELECT event_id, tau0, CASE WHEN t IS NULL OR t < 250 THEN 'history' {day} WHEN tau0 IS NULL AND t + 6 > last_idx THEN 'history' WHEN tau0 IS NULL THEN 'postpone' END AS reject_reason FROM e1""")


def policy_query(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cal = keep(calendar(spark, sf_dir))
        b = keep(bars(spark, sf_dir).join(F.broadcast(cal), "d").withColumn("one_word", (F.col("open") == F.col("close")) & (F.col("high") == F.col("low"))))
        ev = readers.last_day_upto(first_events(spark, sf_dir), cal, "anchor").withColumnRenamed("cal_idx", "anchor_idx")
        return E.clean(ev, b, cal, policy=policy).select("event_id", "tau0", "reject_reason")

    return run


for _policy in E.POLICIES:
    query(f"e02_policy_{_policy}", policy_sql(_policy))(policy_query(_policy))


@query("e05_survivors", sql("SELECT reason AS reject_reason, count(*) AS n FROM fin GROUP BY 1"))
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).final.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("a05_market_model", sql("SELECT event_id, round(alpha, 9) AS alpha, round(beta, 9) AS beta, delta, round(sd, 9) AS sd, round(x_bar, 9) AS x_bar, round(sxx, 9) AS sxx FROM fit WHERE delta >= 3"))
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).fit.filter("delta >= 3").select("event_id", "delta", *r9("alpha", "beta", "sd", "x_bar", "sxx"))


@query("a06_bmp_by_tau", sql("SELECT tau, round(avg(sar) / stddev_samp(sar) * sqrt(count(sar)), 8) AS bmp, count(sar) AS n, round(avg(ar), 9) AS aar FROM sa GROUP BY tau"))
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).ab.groupBy("tau").agg(F.round(E.t_of("sar"), 8).alias("bmp"), F.count("sar").alias("n"), F.round(F.avg("ar"), 9).alias("aar"))


GRP = "'I' || (length(sec) + ascii(right(sec, 1))) % 3"
RHO = f"""rr AS (SELECT res.event_id, cal_idx, e, {GRP} AS grp FROM res JOIN kept USING (event_id)),
pr AS (SELECT a.event_id AS a, b.event_id AS b, count(*) AS n, corr(a.e, b.e) AS rho FROM rr a JOIN rr b ON a.grp = b.grp AND a.cal_idx = b.cal_idx AND a.event_id < b.event_id GROUP BY 1, 2 HAVING count(*) >= 3 AND var_pop(a.e) > 0 AND var_pop(b.e) > 0),
rho AS (SELECT coalesce(avg(rho), 0) AS rho, count(*) AS n_pairs FROM pr)"""


@query("a07_rho_bar", sql(RHO + " SELECT round(rho, 9) AS rho, n_pairs FROM rho"))
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).rho(group()).select("n_pairs", *r9("rho"))


CAR = "ca AS (SELECT event_id, sum(ar) AS car, sum(sar) AS csar FROM sa GROUP BY 1 HAVING count(ar) = 20)"


@query("a09_car_tests", sql(RHO + ", " + CAR + """ SELECT count(*) AS n, round(avg(csar) / stddev_samp(csar) * sqrt(count(*)), 8) AS bmp_car, round(avg(csar) / stddev_samp(csar) * sqrt(count(*)) * sqrt((1 - max(rho)) / (1 + (count(*) - 1) * max(rho))), 8) AS adj_bmp,
  round(avg(car), 9) AS mean_car, round(avg(car) / stddev_samp(car) * sqrt(count(*)), 8) AS naive_t, round(count(*) / (1 + (count(*) - 1) * max(rho)), 6) AS n_eff, round(count(*) * (1 - max(rho)) / (1 + (count(*) - 1) * max(rho)), 6) AS n_eff_kp FROM ca CROSS JOIN rho"""))
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Study(spark, sf_dir).summary(group())
    return x.select("n", *(F.round(c, 8).alias(c) for c in ("bmp_car", "adj_bmp", "naive_t")), *r9("mean_car"), *(F.round(c, 6).alias(c) for c in ("n_eff", "n_eff_kp")))


@query("a11_caar", sql("SELECT layer, round(sum(aar), 9) AS caar, min(n) AS min_n FROM (SELECT layer, tau, avg(ar) AS aar, count(ar) AS n FROM sa GROUP BY 1, 2) GROUP BY layer"))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Study(spark, sf_dir).ab.groupBy("layer", "tau").agg(F.avg("ar").alias("aar"), F.count("ar").alias("n"))
    return g.groupBy("layer").agg(F.round(F.sum("aar"), 9).alias("caar"), F.min("n").alias("min_n"))


RANK_SQL = """al AS (SELECT res.event_id, res.cal_idx - kept.t + 90 AS pos, e AS ar FROM res JOIN kept USING (event_id) UNION ALL SELECT event_id, tau, ar FROM sa WHERE ar IS NOT NULL),
k AS (SELECT pos, (rank() OVER (PARTITION BY event_id ORDER BY ar) + (count(*) OVER (PARTITION BY event_id, ar) - 1) / 2.0) / (count(*) OVER (PARTITION BY event_id) + 1) - 0.5 AS k FROM al),
kb AS (SELECT pos, avg(k) AS kbar, count(*) AS n FROM k GROUP BY pos)"""


def ranks(s: E.Study) -> DataFrame:
    return E.corrado(s.est.join(s.kept.select("event_id"), "event_id", "left_semi"), s.fit, s.ab)


@query("a12_corrado_rank", sql(RANK_SQL + " SELECT pos, n, round(kbar / sqrt((SELECT avg(kbar * kbar) FROM kb)), 6) AS t FROM kb WHERE pos >= 0"))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = keep(ranks(Study(spark, sf_dir)))
    scale = kb.agg(F.sqrt(F.avg(F.col("kbar") * F.col("kbar"))).alias("s"))
    return kb.filter("pos >= 0").crossJoin(scale).select("pos", "n", F.round(F.col("kbar") / F.col("s"), 6).alias("t"))


@query("a12_corrado_windows", sql(RANK_SQL + """, w AS (SELECT unnest([5, 10, 20]) AS len) SELECT len, CASE WHEN count(kbar) = len THEN round(sum(kbar) / (sqrt((SELECT avg(kbar * kbar) FROM kb)) * sqrt(len)), 6) END AS t
FROM w JOIN kb ON pos >= 0 AND pos < len GROUP BY len"""))
def a12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulated statistic of each window; NULL where a day of it has no ranks."""
    return E.corrado_windows(keep(ranks(Study(spark, sf_dir))), [5, 10, 20]).select("len", F.round("t", 6).alias("t"))


@query("a13_calendar_time", sql("SELECT round(avg(p), 9) AS mean, round(avg(p) / stddev_samp(p) * sqrt(count(*)), 8) AS t, count(*) AS n_days FROM (SELECT idx, avg(ar) AS p FROM sa WHERE ar IS NOT NULL GROUP BY idx)"))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calendar_time(Study(spark, sf_dir).ab, length=LENGTH).select("n_days", F.round("mean", 9).alias("mean"), F.round("t", 8).alias("t"))


@query("a15_bhar_moments", sql("""b AS (SELECT event_id, exp(sum(r0)) - exp(sum(rm)) AS x FROM (SELECT sa.event_id, r.r AS r0, sa.rm FROM sa JOIN r ON r.sec = sa.sec AND r.cal_idx = sa.idx WHERE r.r IS NOT NULL) GROUP BY 1 HAVING count(*) = 20),
g AS (SELECT avg(x) AS mu, stddev_samp(x) AS s, count(*) AS n FROM b), k AS (SELECT sum(power(x - mu, 3)) / (max(n) * power(max(s), 3)) AS skew FROM b CROSS JOIN g)
SELECT n, round(mu, 8) AS mean, round(skew, 6) AS skew, round(sqrt(n) * (mu / s + skew * (mu / s) * (mu / s) / 3 + skew * skew * power(mu / s, 3) / 27 + skew / (6 * n)), 6) AS t_sa FROM g CROSS JOIN k"""))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Study(spark, sf_dir)
    b = s.ab.filter("r is not null").groupBy("event_id").agg((F.exp(F.sum("r")) - F.exp(F.sum("rm"))).alias("x"), F.count("*").alias("k")).filter(F.col("k") == LENGTH)
    g = b.agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("s"), F.count("*").alias("n"), F.skewness("x").alias("sk"))
    g = g.withColumn("skew", F.col("sk") * F.pow((F.col("n") - 1) / F.col("n"), F.lit(1.5))).withColumn("q", F.col("mu") / F.col("s"))
    q, k = F.col("q"), F.col("skew")
    t = F.sqrt(F.col("n").cast("double")) * (q + k * q * q / 3 + k * k * F.pow(q, F.lit(3)) / 27 + k / (6 * F.col("n")))
    return g.select("n", F.round("mu", 8).alias("mean"), F.round("skew", 6).alias("skew"), F.round(t, 6).alias("t_sa"))


@query("e10_censor_panel", sql("SELECT tau, count(*) FILTER (ar IS NULL) AS suspend, count(*) AS n FROM sa GROUP BY tau"))
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Study(spark, sf_dir).ab.groupBy("tau").agg(F.count_if(F.col("ar").isNull()).alias("suspend"), F.count("*").alias("n"))


@query("a16_sharpe_moments", sql("""b AS (SELECT event_id, sum(ar) AS x FROM sa WHERE ar IS NOT NULL GROUP BY 1), g AS (SELECT avg(x) AS mu, stddev_samp(x) AS s, stddev_pop(x) AS p, count(*) AS n FROM b)
SELECT max(n) AS n, round(max(mu / s), 8) AS sharpe, round(avg(power((x - mu) / p, 3)), 6) AS skew, round(avg(power((x - mu) / p, 4)), 6) AS kurt FROM b CROSS JOIN g"""))
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Study(spark, sf_dir).ab.filter("ar is not null").groupBy("event_id").agg(F.sum("ar").alias("x"))
    return b.agg(F.nullif(F.count("x"), F.lit(0)).alias("n"), F.round(F.avg("x") / F.stddev_samp("x"), 8).alias("sharpe"), F.round(F.skewness("x"), 6).alias("skew"), F.round(F.kurtosis("x") + 3, 6).alias("kurt"))


@query("a21_rejections_by_year", sql("""y AS (SELECT year(anchor) AS year, coalesce(reason, 'valid') AS outcome, count(*) AS n FROM fin GROUP BY 1, 2)
SELECT year, outcome, n, round(n / sum(n) OVER (PARTITION BY year), 9) AS ratio, (SELECT count(*) FILTER (reason IS NOT NULL) / count(*) FROM fin) > 0.05 AS alert FROM y"""))
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections by year and reason; alert if more than 5 % of all events are rejected."""
    f = Study(spark, sf_dir).final.groupBy(F.year("anchor").cast("long").alias("year"), F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))
    total = f.agg((F.sum(F.when(F.col("outcome") != "valid", F.col("n")).otherwise(0)) / F.sum("n") > 0.05).alias("alert"))
    return f.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 9)).crossJoin(total)  # a single row


@query("t02_total_order", "SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_custkey % 50 = 0")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in one total order: NULL dates first, then by price, ties by key; a customer sample's rows fit one task."""
    from eventide.sources.panel import read

    day = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    w = Window.orderBy(day.asc_nulls_first(), F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return read(spark, sf_dir, "orders").filter("o_custkey % 50 = 0").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))
