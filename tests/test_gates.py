"""Checks that fail a job on the executor; the normal distribution and deflated ratios against plain ones."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from eventide.functions.normal import normal_cdf, normal_quantile
from eventide.operators import gates as G
from eventide.operators import sharpe
from eventide.operators import study as E
from eventide.operators import verdicts as V


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_required_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None)], "k int, v double")
    assert G.require(df.filter("k = 1"), F.col("v") > 0, "not positive", "k").count() == 1
    fails(G.require(df.filter("k < 3"), F.col("v") > 0, "not positive", "k", "v").select("k"), r'not positive: \{"k":2,"v":-1.0\}')
    fails(G.require(df.filter("k <> 2"), F.col("v") > 0, "not positive", "k", "v"), r'"v":null')


def test_holdout_guard(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-06-27', date'2024-06-30')) AS d")
    assert G.guard_holdout(days, "d").count() == 4
    fails(G.guard_holdout(days.union(spark.sql("SELECT date'2024-07-01'")), "d"), "a row of the holdout")
    fails(G.guard_holdout(days.union(spark.sql("SELECT cast(null as date)")), "d"), "a row of the holdout")


def test_conservation(spark):
    before = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sec string, id int")
    after = before.withColumn("outcome", F.when(F.col("id") == 1, "event").otherwise("st"))
    rows = {r.sec: r.asDict() for r in G.conserved(before, after, ["sec"], outcome="outcome").collect()}
    assert rows["a"] == {"sec": "a", "n_in": 2, "outcomes": {"event": 1, "st": 1}} and rows["b"]["n_in"] == 1
    for wrong in (after.filter("id <> 2"), after.union(after.filter("id = 3")), after.filter("sec = 'a'"), after.withColumn("sec", F.lit("c"))):
        fails(G.conserved(before, wrong, ["sec"], outcome="outcome"), "rows are lost or gained")


def test_rows_behind_a_check(spark):
    rows = spark.range(3)
    good = rows.agg(G.checked(F.count("*"), F.count("*") == 3, "three rows").alias("n"))
    assert G.behind(rows, good).count() == 3
    fails(G.behind(rows, rows.agg(G.checked(F.count("*"), F.count("*") == 4, "four rows").alias("n"))), "four rows")


def test_funnel_counts_in_passing(spark):
    funnel = G.Funnel()
    df = funnel.count(spark.range(10), "in", even=F.col("id") % 2 == 0)
    assert funnel.count(df.filter("id < 4"), "out").count() == 4
    assert funnel.counts() == {"in": {"n": 10, "even": 5}, "out": {"n": 4}}
    funnel.require("less out than in", funnel.counts()["out"]["n"] <= 10)
    with pytest.raises(ValueError, match="all come out"):
        funnel.require("all come out", funnel.counts()["out"]["n"] == 10)


def test_correction_without_value(spark):
    df = spark.createDataFrame([(0.1, 30), (-0.5, 2)], "rho double, n int")
    assert [round(r.f, 9) for r in df.select(E.kp_factor(F.col("rho"), F.col("n")).alias("f")).collect()] == [round((0.9 / 3.9) ** 0.5, 9), round(3**0.5, 9)]
    bad = spark.createDataFrame([(-0.5, 3)], "rho double, n int")
    fails(bad.select(E.kp_factor(F.col("rho"), F.col("n"))), "no correction: the denominator is")
    assert bad.select(E.kp_factor(F.col("rho"), F.col("n"), strict=False)).first()[0] is None
    assert V.verdict(100, float("nan")) == V.verdict(100, None) == "AMBIGUOUS" and V.verdict(100, float("nan"), policy="adj_bmp_main_only") == "AMBIGUOUS"


def test_normal_distribution(spark):
    ps = [1e-300, 1e-12, 1e-6, 0.001, 0.0013, 0.00135, 0.0014, 0.02425, 0.3, 0.499999999, 0.5, 0.500000001, 0.7, 0.975, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)
    zs = [-40.0, -8.0, -3.0000001, -3.0, -2.9999999, -1.0, -1e-9, 0.0, 0.5, 2.0, 3.0, 7.0, 40.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.z), abs=1e-15, rel=1e-12 if r.z > -3 else 1e-9)
    assert spark.sql("SELECT cast(null as double) AS p").select(normal_quantile(F.col("p")), normal_cdf(F.col("p"))).first()[:] == (None, None)
    for p in (0.0, 1.0, -0.5, 1.5):
        fails(spark.createDataFrame([(p,)], "p double").select(normal_quantile(F.col("p"))), "no quantile of")


def test_deflated_ratios_equal_scalars(spark):
    rows = [("f", f"t{i}", float((i * 7 + k * k * 13) % 11) / 10 - 0.4) for i in range(4) for k in range(12)] + [("g", "one", float(k % 5)) for k in range(9)] + [("g", "flat", 1.0)] * 4 + [("h", "short", 0.1), ("h", "short", 0.2)]
    df = spark.createDataFrame(rows, "family string, trial string, x double")
    trials = sharpe.trial_moments(df, ["family", "trial"])
    out = {(r.family, r.trial, r["mode"]): r for r in sharpe.deflated_sharpe(trials, ["family"], given=F.lit(0.01)).collect()}
    known = {(r.family, r.trial): r for r in trials.collect()}
    assert len(out) == 3 * len(known)
    for (family, trial, mode), r in out.items():
        m = {k: r[k] for k in ("n", "sharpe", "skew", "kurt")}
        own = [x.sharpe for (f, _), x in known.items() if f == family and x.sharpe is not None]
        if m["skew"] is None:
            assert r.dsr is None and r.sr_star is None
        elif mode == "trial_var" and len(own) < 2:
            assert r.v is None and r.dsr is None
        else:
            want = V.deflated_sharpe(m, sum(f == family for f, _ in known), mode=mode, trial_sharpes=own, variance=0.01)
            assert (r.v, r.sr_star, r.psr, r.dsr) == pytest.approx((want["v"], want["sr_star"], want["psr"], want["dsr"]), abs=1e-12)
    assert out["g", "one", "proxy"].trials == 2 and known["g", "flat"].sharpe is None
