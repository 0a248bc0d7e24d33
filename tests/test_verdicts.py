import math

import pytest

from eventide.operators import ledger as L
from eventide.operators import verdicts as V


@pytest.mark.parametrize(
    "n,adj,kw,want",
    [
        (29, 5.0, {}, "INSUFFICIENT"), (30, None, {}, "AMBIGUOUS"), (30, 3.0, {"naive": 4, "rank": 1, "calendar": 1}, "SIG"), (30, 1.0, {"naive": 4, "rank": -1, "calendar": -1}, "NOT_SIG"),
        (30, 3.0, {"rank": 1, "calendar": -1}, "AMBIGUOUS"), (30, 3.0, {"rank": -1, "calendar": 1}, "AMBIGUOUS"), (30, 1.0, {"rank": 1, "calendar": 1}, "NOT_SIG"), (30, 3.0, {}, "AMBIGUOUS"),
        (30, 3.0, {"rank": -1, "calendar": -1, "policy": "adj_bmp_main_only"}, "SIG"),
    ],
)
def test_verdict(n, adj, kw, want):
    assert V.verdict(n, adj, **kw) == want


def test_windows():
    assert V.test_windows("事件版 20/60 日") == [20, 60] and V.test_windows("公告后 5/20/60日") == [5, 20, 60]
    for bad in ("60/20 日", "后 20 日", "后 20/20 日", ""):
        with pytest.raises(ValueError):
            V.test_windows(bad)


def test_deflated_sharpe(spark):
    m = V.moments(spark.createDataFrame([(0.0,), (0.0,), (3.0,)], "x double"))
    assert m["skew"] == pytest.approx(1 / math.sqrt(2)) and m["kurt"] == pytest.approx(1.5)
    out = V.deflated_sharpe({"n": 100, "sharpe": 0.2, "skew": 0.0, "kurt": 3.0}, 2)
    assert out["psr"] == pytest.approx(V.NORMAL.cdf(0.2 * math.sqrt(99 / 1.02))) and out["dsr"] < out["psr"]
    assert V.deflated_sharpe({"n": 1, "sharpe": None, "skew": None, "kurt": None}, 2)["dsr"] is None


def test_gates():
    V.check_transition(None, "registered")
    V.check_transition("running", "done")
    V.check_execution({"execution_profile": "close_to_next_open", **V.CLOSE_TO_NEXT_OPEN})
    V.check_dependencies({"a": 1}, {"a": 1})
    for f, args in ((V.check_transition, (None, "done")), (V.check_transition, ("done", "running")), (V.check_execution, ({"decision_time": "close_confirmed", "fill_time": "same_close"},)), (V.check_dependencies, ({"a": 1}, {"a": 2})), (V.check_dependencies, ({"a": 1}, {}))):
        with pytest.raises(ValueError):
            f(*args)
    with pytest.raises(ValueError):
        V.check_transition(None, "registered", llm=True)
    tail = {"execution_profile": "preclose_to_tail", "decision_cutoff": "14:30", "decision_price_source": "last", "fill_window": {"start": "14:50", "end": "15:00"}, "fill_price_rule": "vwap", "slippage_rule": "frozen_cost"}
    V.check_execution(tail)
    for bad in ({"decision_cutoff": "14:50"}, {"decision_cutoff": "2 pm"}, {"fill_window": {"start": "15:00", "end": "14:00"}}, {"fill_price_rule": " "}, {"execution_profile": "other"}):
        with pytest.raises(ValueError):
            V.check_execution(tail | bad)
    assert V.resolve_execution({"execution_profile": "close_to_next_open", **V.CLOSE_TO_NEXT_OPEN}) == "next_open"
    with pytest.raises(ValueError):
        V.resolve_execution(tail)
    assert V.deep_diff({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}], "c": 0}) == ["$.a[1].b", "$.c"]


def test_size(spark):
    r = V.size_test(spark, sims=300).toPandas()
    assert r["naive"].mean() > 0.25 and 0.01 < r["adjusted"].mean() < 0.11
    assert abs(r["rho"].mean() - 0.25) < 0.05


def test_alignment_and_roles():
    assert [V.effect_alignment("SIG", x) for x in (2.0, -2.0, 0.0, None)] == ["ALIGNED", "REVERSED", "NEUTRAL", "UNAVAILABLE"] and V.effect_alignment("AMBIGUOUS", 3.0) == "UNAVAILABLE"
    assert V.field_roles({"adj_bmp_car": 1, "n": 2, "field_roles": {}}) == {"adj_bmp_car": "VERDICT_AUTHORITY", "n": "CONTEXT"}
    with pytest.raises(ValueError):
        V.field_roles({"new_stat": 1})
    with pytest.raises(PermissionError):
        V.require_holdout_approval(False)
    a = {"n_valid": 5, "verdict": "SIG", "rejections": {"by_year": {2020: {"total": 3, "rejected": 1, "by_reason": {"st": 1}}}}, "audit": 1}
    b = {"n_valid": 6, "verdict": "SIG", "rejections": {"by_year": {2020: {"total": 3, "rejected": 2, "by_reason": {"st": 1, "history": 1}}}}, "audit": 2}
    assert V.rerun_diff(a, b, ignore=("$.audit",)) == ["$.n_valid", "$.rejections.by_year.2020.by_reason.history", "$.rejections.by_year.2020.rejected"]
    assert V.rerun_diff(a, b, ignore=("$.audit", "$.n", "$.rejections")) == ["$.n_valid"]


PLAN = {k: "x" for k in L.REQUIRED} | {"pap_schema_version": 2, "analysis_type": "event"}


def test_ledger(spark, tmp_path):
    book = L.Ledger(spark, str(tmp_path / "ledger"))
    one = book.register(family="f", title="t", source_type="human", verdict_power="full", plan=PLAN)
    two = book.register(family="f", title="u", source_type="llm", verdict_power="prescreen", plan=PLAN)
    for status in ("frozen", "running"):
        book.step(one, status)
    book.finish(one, {"verdict": "SIG"})
    book.step(two, "closed", "replaced")
    rows = {r.exp_id: r for r in book.state().collect()}
    assert (rows[one].status, rows[one].family_trial, rows[two].family_trial, rows[two].closure_reason) == ("done", 1, 2, "replaced") and '"SIG"' in rows[one].result
    for step in ((one, "running", None), (two, "frozen", None), (99, "frozen", None), (two, "done", "x")):
        with pytest.raises(ValueError):
            book.step(*step)
    for wrong in ({"source_type": "llm", "verdict_power": "full"}, {"source_type": "other"}, {"plan": PLAN | {"pool": ""}}, {"plan": PLAN | {"analysis_type": "strategy"}}, {"plan": PLAN | {"pap_schema_version": 1}}):
        with pytest.raises(ValueError):
            book.register(**({"family": "f", "title": "t", "source_type": "human", "verdict_power": "full", "plan": PLAN} | wrong))


def test_manifests(spark, tmp_path):
    facts = spark.createDataFrame([(s, b) for s in L.FACTS for b in (1, 2)], "source string, batch_id long")
    derived = spark.createDataFrame([(s, 7) for s in L.DERIVED], "source string, batch_id long")
    content, path = L.manifest(facts, derived), str(tmp_path / "manifests")
    assert content["facts"]["daily"] == 2
    with pytest.raises(ValueError):
        L.manifest(facts.filter("source <> 'daily'"))
    with pytest.raises(ValueError):
        L.published(spark, path, 1)
    assert L.publish(spark, path, 1, content) == L.publish(spark, path, 1, content)
    assert L.published(spark, path, 1) == content and len(list((tmp_path / "manifests").glob("*.json"))) == 2
    with pytest.raises(ValueError):
        L.publish(spark, path, 1, content | {"facts": {}})
    L.check_lineage(content, {"market_return": {"daily": 2}}, {"pool_b1_return": ("pool_b1", 7)})
    for args in (({"market_return": {"daily": 1}}, {}), ({}, {"pool_b1_return": ("pool_b1", 6)})):
        with pytest.raises(ValueError):
            L.check_lineage(content, *args)
