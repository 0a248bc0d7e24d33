"""Verdict columns against the ladder of scalars, and the table of studies against studies one by one."""

import itertools

import pytest
from pyspark.sql import functions as F

from eventide import registry
from eventide.operators import study as E
from eventide.operators import study_table as T
from eventide.operators import verdicts as V
from eventide.sources.panel import DENSE, bars, calendar, first_events, industry

SF = "/root/testdata/sf0.01"


def test_verdict_columns_equal_scalars(spark):
    values = [None, float("nan"), -4.0, -1.0, 0.0, 1.0, 4.0]
    grid = [(n, *v, a) for n in (29, 30) for v in itertools.product(values, repeat=4) for a in (0.05, 0.0125)]
    df = spark.createDataFrame(grid, "n int, adj double, naive double, rank double, cal double, alpha double")
    args = [F.col(c) for c in ("n", "adj", "naive", "rank", "cal", "alpha")]
    main = T.verdict(*args, policy="adj_bmp_main_only")
    rows = df.select("*", T.verdict(*args).alias("three"), main.alias("main"), T.alignment(main, F.col("adj")).alias("effect")).collect()
    for r in rows:
        kw = {"naive": r.naive, "rank": r["rank"], "calendar": r.cal, "alpha": r.alpha}
        assert r.three == V.verdict(r.n, r.adj, **kw)
        assert r.main == V.verdict(r.n, r.adj, policy="adj_bmp_main_only", **kw)
        assert r.effect == V.effect_alignment(r.main, r.adj)
    assert {r.three for r in rows} == {"SIG", "NOT_SIG", "INSUFFICIENT", "AMBIGUOUS"}
    with pytest.raises(ValueError):
        T.verdict(*args, policy="other")


def test_table_equals_single_studies(spark):
    b, c, ev = (registry.keep(x) for x in (bars(spark, SF, DENSE), calendar(spark, SF), first_events(spark, SF, DENSE)))
    specs = [E.Spec(10), E.Spec(5, "pool", ("SMALL", "LARGE", "PROMO")), E.Spec(10, min_obs=1000)]
    # a layer whose events come too early for any estimation window
    ev = ev.withColumn("layer", F.when(F.col("anchor") < "1995-06-01", "early").otherwise(F.col("layer")))
    rows = {(r.spec, r.layer): r for r in T.studies(b, c, ev, specs, registry.keep, group=industry(F.col("sec"))).collect()}
    assert len(rows) == 3 * 5
    for s in specs:
        one = E.run_study(b, c, ev, s, group=industry(F.col("sec"))).first()
        r = rows[s.digest[:12], "all"]
        assert r.n == one.n and r.n_pairs == one.n_pairs and r.alpha == 0.05 / 3
        for mine, its in (("mean_car", "mean_car"), ("bmp_car", "bmp_car"), ("adj_bmp", "adj_bmp"), ("naive_t", "naive_t")):
            assert r[mine] == (None if one[its] is None else pytest.approx(one[its], abs=1e-9))
        assert rows[s.digest[:12], "all"].n_valid == sum(x.n_valid for (i, lay), x in rows.items() if i == s.digest[:12] and lay != "all")
        early = rows[s.digest[:12], "early"]
        assert early.n_valid == 0 and early.status == "UNESTIMABLE_BY_FROZEN_COVERAGE" and early.verdict == "INSUFFICIENT" and early.effect == "UNAVAILABLE"
    assert rows[specs[0].digest[:12], "all"].status == "TESTED" and rows[specs[2].digest[:12], "all"].n_valid == 0
    with pytest.raises(ValueError):
        T.studies(b, c, ev, [E.Spec(10), E.Spec(10)], registry.keep, group=F.lit("x"))
    registry.close_all()
