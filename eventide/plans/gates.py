"""Queries whose checks run inside the plan, and the normal distribution and deflated Sharpe ratios as data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.normal import cdf_sql, normal_cdf, normal_quantile, quantile_sql
from eventide.operators import gates as G
from eventide.operators import returns as R
from eventide.operators import selection as X
from eventide.operators import sharpe
from eventide.operators import study as E
from eventide.plans.selection import FROM, TO, chain_sql, limit_rows, listings
from eventide.plans.study import RHO, Study, group, r9, sql
from eventide.registry import keep, own, query
from eventide.sources import readers
from eventide.sources.bisection import around, collected
from eventide.sources.ingest import ingest
from eventide.sources.landing import Folder, Landing
from eventide.sources.panel import bars, industry, panel_sql, read
from eventide.sources.work import shared_dir


@query("s19_guarded_panel", panel_sql("SELECT sec, count(*) AS n, max(d) AS last_d FROM bars WHERE d < DATE '1998-09-01' GROUP BY sec"))
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars behind both guards: the view's filter, and the check that fails the job on any row of the holdout that still comes."""
    # the panel's dates lie decades before the holdout, and its last months count as held out here
    shift = lambda d, months: F.add_months(d, months)
    rows = bars(spark, sf_dir).withColumn("seen", shift(F.col("d"), 310))  # 1998-09 is 2024-07
    rows = G.guard_holdout(readers.before_holdout(rows, "seen"), "seen")
    return rows.groupBy("sec").agg(F.count("*").alias("n"), F.max("d").alias("last_d"))


@query("a36_conserved_chains", f"WITH q AS ({chain_sql('down')}) SELECT sec, count(*) AS n_in, count(*) FILTER (outcome = 'event') AS events FROM q GROUP BY sec")
def a36_by_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each security the chains of rows at the limit, counted before selection, are the events and rejects after it; one that loses a chain fails the job."""
    rows = keep(limit_rows(spark, sf_dir))
    at = (F.col("one_word") & (F.col("open_at") == "down")).cast("int")
    w = X.forward()
    begun = rows.withColumns({"m": at, "b": F.coalesce(F.lag(at).over(w), F.lit(0)), "a": F.coalesce(F.lead(at).over(w), F.lit(0))}).filter("m = 1 and b = 0 and a = 1")
    chains = X.limit_chains(rows, listings(spark, sf_dir), side="down", start=FROM, end=TO)
    return G.conserved(begun, chains, ["sec"], outcome="outcome").select("sec", "n_in", F.coalesce(F.element_at("outcomes", "event"), F.lit(0)).alias("events"))


@query("a08_adj_bmp_by_tau", sql(RHO + """ SELECT tau, count(sar) AS n, round(avg(sar) / stddev_samp(sar) * sqrt(count(sar)), 8) AS bmp, round(sqrt((1 - max(rho)) / (1 + (count(sar) - 1) * max(rho))), 8) AS kp_factor,
  round(avg(sar) / stddev_samp(sar) * sqrt(count(sar)) * sqrt((1 - max(rho)) / (1 + (count(sar) - 1) * max(rho))), 7) AS adj_bmp FROM sa CROSS JOIN rho GROUP BY tau"""))
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correction with the number of events of each tau; the job fails where it has no value."""
    s = Study(spark, sf_dir)
    days = s.ab.groupBy("tau").agg(F.count("sar").alias("n"), E.t_of("sar").alias("bmp")).crossJoin(s.rho(group()))  # a single row
    factor = F.when(F.col("bmp").isNotNull(), E.kp_factor(F.col("rho"), F.col("n")))
    return days.select("tau", "n", F.round("bmp", 8).alias("bmp"), F.round(factor, 8).alias("kp_factor"), F.round(F.col("bmp") * factor, 7).alias("adj_bmp"))


LAND_SQL = "SELECT year(o_orderdate) AS batch_id, count(*) AS rows, count(DISTINCT month(o_orderdate)) AS shards, count(*) FILTER (o_orderkey % 5 = 0) AS duplicates, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1"


@query("k01_landed_batches", LAND_SQL)
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of orders landed as batches: rows that come twice are dropped by shard (month), and batches that break a rule leave nothing to read."""
    table = Landing(spark, f"{shared_dir(spark)}/eventide-landing-{uuid.uuid4().hex}")
    own(table.folder.delete)
    orders = read(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    counts = {r["year"]: r for r in orders.groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("month").alias("shards")).collect()}  # a row a year
    records = []
    for year in (1996, 1997, 1998, 1999):
        rows = orders.filter(F.col("year") == year).drop("year")
        twice = rows.unionByName(rows.filter("o_orderkey % 5 = 0"))
        wrong = year == 1999  # a shard that is missing: the batch must not appear
        try:
            records.append(table.land(twice, year, expect=counts[year]["n"], shard="month", expect_shards=counts[year]["shards"] + wrong, distinct=True, unique=["o_orderkey"]))
        except ValueError:
            if not wrong:
                raise
    landed = spark.createDataFrame([(r.batch_id, r.shards, r.duplicates) for r in records], "batch_id long, shards long, duplicates long")
    total = F.round(F.sum("o_totalprice").cast("double"), 2).alias("total")
    return spark.read.parquet(table.path).groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count("*").alias("rows"), total).join(F.broadcast(landed), "batch_id", "left")


@query("s22_resumed_ingest", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 0 ELSE 1 END AS batch_id, event_type, count(*) AS n, count(DISTINCT event_id) AS keys, CAST(round(sum(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of JSON lines that come in two sets; the second run goes on where the first ended."""
    at = f"{shared_dir(spark)}/eventide-ingest-{uuid.uuid4().hex}"
    own(Folder(spark, at).delete)
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "ts")
    first = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    for part in (rows.filter(first), rows.filter(~first)):
        part.drop("ts").write.mode("append").json(f"{at}/in")
        ingest(spark, f"{at}/in", part.drop("ts").schema, ["event_id"], f"{at}/table", f"{at}/checkpoint")
    total = F.round(F.sum("value").cast("double"), 2).alias("total")
    return spark.read.parquet(f"{at}/table").groupBy("batch_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"), total)


BISECT_SQL = """WITH RECURSIVE d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
h AS (SELECT DISTINCT event_type, DATE '2024-01-01' AS lo, DATE '2024-12-31' AS hi FROM events
  UNION ALL SELECT h.event_type, CASE WHEN s.i = 0 THEN lo ELSE lo + CAST(floor((hi - lo) / 2) AS INTEGER) + 1 END, CASE WHEN s.i = 0 THEN lo + CAST(floor((hi - lo) / 2) AS INTEGER) ELSE hi END
  FROM h, (VALUES (0), (1)) AS s(i) WHERE lo < hi AND (SELECT sum(n) FROM d WHERE d.event_type = h.event_type AND d.day BETWEEN h.lo AND h.hi) > 30),
c AS (SELECT h.event_type, lo, hi, coalesce(sum(n), 0) AS n, CAST(sum(v) AS DOUBLE) AS total FROM h LEFT JOIN d ON d.event_type = h.event_type AND d.day BETWEEN h.lo AND h.hi GROUP BY 1, 2, 3)
SELECT event_type, lo, hi, CAST(n AS BIGINT) AS n, CAST(greatest(1, ceil(n / 30.0)) AS BIGINT) AS pages, round(total, 2) AS total FROM c WHERE n <= 30 OR lo = hi"""


@query("s23_bisected_ranges", BISECT_SQL)
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of events by type, read twice, in the ranges of at most 30 rows (or one day) that halving the year ends in, with the rows that each range holds."""
    events = read(spark, sf_dir, "events").select("event_type", "event_id", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("value"))
    year = events.select("event_type").distinct().select("event_type", F.lit("2024-01-01").cast("date").alias("start"), F.lit("2024-12-31").cast("date").alias("end"))
    rows, ranges = collected(events, events, year, ["event_type"], day="day", id="event_id", page=30)
    # days are summed before they meet their ranges, and meet them by equality: of those around a day one is read
    days = rows.groupBy("event_type", "day").agg(F.sum("value").alias("v")).join(year, "event_type")
    met = days.select("event_type", "v", F.inline(around(F.col("day"), F.col("start"), F.col("end"))).alias("lo", "hi"))
    held = ranges.join(met, ["event_type", "lo", "hi"], "left")
    return held.groupBy("event_type", "lo", "hi", "n", "pages").agg(F.round(F.sum("v").cast("double"), 2).alias("total"))


@query("a18_normal_quantile", f"""WITH p AS (SELECT c_custkey, (c_acctbal + 1000.0) / 11000.0 AS p FROM customer WHERE c_acctbal > -1000 AND c_acctbal < 10000)
SELECT c_custkey, round({quantile_sql('p')}, 10) AS z, round({cdf_sql('(p - 0.5) * 12')}, 12) AS below FROM p""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each account's balance would stand if balances between the bounds were normal, and the distribution function over the whole line."""
    p = ((F.col("c_acctbal").cast("double") + 1000.0) / 11000.0).alias("p")
    rows = read(spark, sf_dir, "customer").filter("c_acctbal > -1000 and c_acctbal < 10000").select("c_custkey", p)
    return rows.select("c_custkey", F.round(normal_quantile(F.col("p")), 10).alias("z"), F.round(normal_cdf((F.col("p") - 0.5) * 12), 12).alias("below"))


DSR_SQL = f"""x AS (SELECT sec, ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE)) AS x FROM bars),
g AS (SELECT sec, avg(x) AS mu, stddev_samp(x) AS s, stddev_pop(x) AS p, count(x) AS n FROM x GROUP BY sec),
t AS (SELECT x.sec, max(n) AS n, max(mu / s) AS sr, avg(power((x - mu) / p, 3)) AS skew, avg(power((x - mu) / p, 4)) AS kurt FROM x JOIN g USING (sec) WHERE x IS NOT NULL AND s > 0 GROUP BY x.sec HAVING max(n) >= 3),
f AS (SELECT *, 'I' || (length(sec) + ascii(right(sec, 1))) % 3 AS family FROM t),
v AS (SELECT *, count(*) OVER (PARTITION BY family) AS trials, CASE WHEN count(*) OVER (PARTITION BY family) >= 2 THEN var_pop(sr) OVER (PARTITION BY family) END AS tv, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS sp FROM f),
m AS (SELECT *, unnest(['proxy', 'trial_var', 'given']) AS mode, unnest([sp / (n - 1), tv, 0.0004]) AS v FROM v),
b AS (SELECT *, CASE WHEN trials < 2 OR v <= 0 THEN 0 ELSE sqrt(v) * ((1 - {sharpe.EULER!r}) * {quantile_sql('1 - 1.0 / trials')} + {sharpe.EULER!r} * {quantile_sql('1 - 1.0 / (trials * exp(1))')}) END AS sr_star FROM m)
SELECT family, sec, mode, n, trials, round(sr, 9) AS sharpe, round(v, 10) AS v, round(sr_star, 9) AS sr_star, round({cdf_sql('sr * sqrt(n - 1) / sqrt(sp)')}, 7) AS psr, round({cdf_sql('(sr - sr_star) * sqrt(n - 1) / sqrt(sp)')}, 7) AS dsr FROM b"""


@query("a17_deflated_sharpe", panel_sql(DSR_SQL))
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every security's daily returns as a trial of its industry's family, in the three modes."""
    returns = R.gap_returns(bars(spark, sf_dir)).select("sec", F.col("ret").alias("x"))
    trials = sharpe.trial_moments(returns, ["sec"]).filter("sharpe is not null and skew is not null").withColumn("family", industry(F.col("sec")))
    out = sharpe.deflated_sharpe(trials, ["family"], given=F.lit(0.0004))
    return out.select("family", "sec", "mode", "n", "trials", *r9("sharpe", "sr_star"), F.round("v", 10).alias("v"), *(F.round(c, 7).alias(c) for c in ("psr", "dsr")))
