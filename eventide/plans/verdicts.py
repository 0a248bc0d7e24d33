"""Verdicts of a whole family of studies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.normal import quantile_sql
from eventide.operators import study as E
from eventide.operators.documents import result_documents
from eventide.operators.gates import require
from eventide.operators.study_table import studies
from eventide.plans.strata import MARKET, STATIC
from eventide.plans.study import BASE, GRP, group, r9
from eventide.registry import keep, own, query
from eventide.sources.landing import Landing
from eventide.sources.panel import DENSE, bars, calendar, first_events, panel_sql
from eventide.sources.work import shared_dir

SPECS = [E.Spec(20), E.Spec(10), E.Spec(10, "pool", tuple(STATIC)), E.Spec(20, policy="unified_announcement")]
FREE = "(SELECT min(r.cal_idx) FROM r WHERE r.sec = e0.sec AND r.cal_idx BETWEEN e0.t + 1 AND e0.t + 6) AS tau0"


def spec_sql(spec: E.Spec, alpha: float) -> str:
    """The ladder of one spec by layer, for DuckDB."""
    base = BASE.replace("tau0 + 19", f"tau0 + {spec.length - 1}").replace("range(20)", f"range({spec.length})")
    assert MARKET in base and FREE in base
    if spec.benchmark == "pool":
        base = base.replace(MARKET, f"m AS (SELECT cal_idx, avg(r) AS rm FROM r WHERE r IS NOT NULL AND sec IN {spec.members} GROUP BY 1)")
    if spec.policy == "unified_announcement":
        base = base.replace(FREE, FREE.replace("FROM r WHERE", "FROM (SELECT sec, cal_idx FROM bars JOIN cal USING (d) WHERE NOT (open = close AND high = low)) r WHERE"))
    benchmark = "pool:" + ",".join(sorted(spec.members)) if spec.members else spec.benchmark
    return panel_sql(base + f""", kl AS (SELECT event_id, unnest(['all', layer]) AS lay FROM kept),
tot AS (SELECT lay, count(*) AS n_events, count(*) FILTER (reason IS NULL) AS n_valid, coalesce(bool_and(reason IN ('coverage', 'history')) FILTER (reason IS NOT NULL), true) AS thin FROM (SELECT reason, unnest(['all', layer]) AS lay FROM fin) GROUP BY lay),
ca AS (SELECT event_id, sum(ar) AS car, sum(sar) AS csar FROM sa GROUP BY 1 HAVING count(ar) = {spec.length}),
ct AS (SELECT lay, count(*) AS n, avg(car) AS mean_car, avg(car) / stddev_samp(car) * sqrt(count(*)) AS naive_t, avg(csar) / stddev_samp(csar) * sqrt(count(csar)) AS bmp_car FROM kl JOIN ca USING (event_id) GROUP BY lay),
rr AS (SELECT lay, res.event_id, cal_idx, e, {GRP} AS grp FROM res JOIN kept USING (event_id) JOIN kl USING (event_id)),
pr AS (SELECT a.lay, a.event_id AS a, b.event_id AS b, corr(a.e, b.e) AS rho FROM rr a JOIN rr b ON a.lay = b.lay AND a.grp = b.grp AND a.cal_idx = b.cal_idx AND a.event_id < b.event_id GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND var_pop(a.e) > 0 AND var_pop(b.e) > 0),
rl AS (SELECT lay, avg(rho) AS rho, count(*) AS n_pairs FROM pr GROUP BY lay),
al AS (SELECT res.event_id, res.cal_idx - kept.t + 90 AS pos, e AS ar FROM res JOIN kept USING (event_id) UNION ALL SELECT event_id, tau, ar FROM sa WHERE ar IS NOT NULL),
k AS (SELECT event_id, pos, (rank() OVER (PARTITION BY event_id ORDER BY ar) + (count(*) OVER (PARTITION BY event_id, ar) - 1) / 2.0) / (count(*) OVER (PARTITION BY event_id) + 1) - 0.5 AS k FROM al),
kb AS (SELECT lay, pos, avg(k) AS k FROM k JOIN kl USING (event_id) GROUP BY 1, 2),
rk AS (SELECT lay, CASE WHEN count(*) FILTER (pos >= 0) = {spec.length} THEN sum(k) FILTER (pos >= 0) / (sqrt(avg(k * k)) * sqrt({spec.length})) END AS rank_t FROM kb GROUP BY lay),
cd AS (SELECT lay, avg(p) / stddev_samp(p) * sqrt(count(*)) AS calendar_t FROM (SELECT lay, idx, avg(ar) AS p FROM sa JOIN kl USING (event_id) WHERE ar IS NOT NULL GROUP BY 1, 2) GROUP BY lay),
x AS (SELECT tot.lay AS layer, n_events, n_valid, coalesce(n, 0) AS n, mean_car, naive_t, bmp_car, coalesce(n_pairs, 0) AS n_pairs, bmp_car * CASE WHEN 1 + (n - 1) * coalesce(rho, 0) > 0 THEN sqrt((1 - coalesce(rho, 0)) / (1 + (n - 1) * coalesce(rho, 0))) END AS adj, rank_t, calendar_t, thin
  FROM tot LEFT JOIN ct USING (lay) LEFT JOIN rl USING (lay) LEFT JOIN rk USING (lay) LEFT JOIN cd USING (lay)),
z AS (SELECT *, {quantile_sql(f'1 - {alpha!r} / 2')} AS z FROM x),
v AS (SELECT *, CASE WHEN n_valid < 30 THEN 'INSUFFICIENT' WHEN adj IS NULL THEN 'AMBIGUOUS' WHEN abs(adj) > z THEN 'SIG' ELSE 'NOT_SIG' END AS main_only FROM z)
SELECT '{spec.digest[:12]}' AS spec, {spec.length} AS length, '{benchmark}' AS benchmark, '{spec.policy}' AS policy, layer, n_events, n_valid, n, round(mean_car, 9) AS mean_car, round(naive_t, 7) AS naive_t, round(bmp_car, 7) AS bmp_car, n_pairs, round(adj, 7) AS adj_bmp,
  round(rank_t, 6) AS rank_t, round(calendar_t, 7) AS calendar_t, CAST({alpha!r} AS DOUBLE) AS alpha, main_only,
  CASE WHEN main_only IN ('INSUFFICIENT', 'AMBIGUOUS') THEN main_only WHEN abs(coalesce(naive_t, 0)) > z AND main_only = 'NOT_SIG' THEN 'NOT_SIG' WHEN sign(coalesce(calendar_t, 0)) * sign(adj) < 0 THEN 'AMBIGUOUS'
    WHEN sign(adj) <> 0 AND sign(coalesce(rank_t, 0)) = sign(adj) AND sign(coalesce(calendar_t, 0)) = sign(adj) THEN main_only ELSE 'AMBIGUOUS' END AS verdict,
  CASE WHEN main_only IN ('INSUFFICIENT', 'AMBIGUOUS') THEN 'UNAVAILABLE' WHEN adj > 0 THEN 'ALIGNED' WHEN adj < 0 THEN 'REVERSED' ELSE 'NEUTRAL' END AS effect,
  CASE WHEN n_valid > 0 THEN 'TESTED' WHEN thin THEN 'UNESTIMABLE_BY_FROZEN_COVERAGE' ELSE 'UNESTIMABLE_AFTER_FROZEN_CLEANING' END AS status FROM v""", DENSE)


E12_SQL = " UNION ALL ".join(f"SELECT * FROM ({spec_sql(s, 0.05 / len(SPECS))})" for s in SPECS)


@query("e12_verdicts", E12_SQL)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four studies (two windows, two benchmarks, two policies) by layer, from one reading of the bars."""
    out = studies(bars(spark, sf_dir, DENSE), calendar(spark, sf_dir), first_events(spark, sf_dir, DENSE), SPECS, keep, group=group())
    return out.select(
        "spec", "length", "benchmark", "policy", "layer", "n_events", "n_valid", "n", *r9("mean_car"), *(F.round(c, 7).alias(c) for c in ("naive_t", "bmp_car", "adj_bmp", "calendar_t")), "n_pairs", F.round("rank_t", 6).alias("rank_t"),
        "alpha", "verdict", "main_only", "effect", "status",
    )


@query("k03_result_documents", f"SELECT spec, layer, n_events, n_valid, mean_car, verdict, main_only, status FROM ({E12_SQL})")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four studies as a JSON document each, landed as one batch and read back: what a document says of each layer, if its text still has its digest."""
    table = Landing(spark, f"{shared_dir(spark)}/eventide-results-{uuid.uuid4().hex}")
    own(table.folder.delete)
    table.land(result_documents(e12(spark, sf_dir), ["spec"], "layer"), 1, expect=len(SPECS), unique=["spec"])
    docs = spark.read.parquet(table.path)
    docs = require(docs, F.col("digest") == F.sha2(F.concat("doc", F.lit("\n")), 256), "a document isn't what its digest says", "spec")
    said = "layer map<string, struct<n_events: bigint, n_valid: bigint, mean_car: double, verdict: string, main_only: string, status: string>>"
    return docs.select("spec", F.explode(F.from_json("doc", said, {"mode": "FAILFAST"})["layer"]).alias("layer", "r")).select("spec", "layer", "r.*")
