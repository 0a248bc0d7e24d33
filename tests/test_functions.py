"""Hand-computed values and Python folds as independent oracles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import returns as R
from eventide.functions import titles as T
from eventide.operators import rules as X
from eventide.operators import selection as SEL
from eventide.operators import study as E
from eventide.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def dec(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gap_returns(spark):
    df = spark.createDataFrame([("a", d, c) for d, c in enumerate([10.0, 11.0, None, None, 13.0, 14.0]) if c], "sec string, d int, close double")
    got = [r.ret for r in R.gap_returns(df).orderBy("d").collect()]
    assert got[0] is None and got[1:] == pytest.approx([math.log(1.1), math.log(13 / 11), math.log(14 / 13)])


def test_bmp_of_one_two_three(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert df.agg(E.t_of("x").alias("t")).first().t == pytest.approx(2 * math.sqrt(3))
    assert df.limit(1).agg(E.t_of("x").alias("t")).first().t is None
    assert one(spark, E.kp_factor(F.lit(0.5), F.lit(4))) == pytest.approx(math.sqrt(0.2))


def test_average_ranks(spark):
    df = spark.createDataFrame([(0, 3), (1, 1), (2, 1), (3, 2)], "i int, v int").withColumn("g", F.lit(1))
    got = df.select("i", R.average_rank(df, ["g"], "v").alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [4, 1.5, 1.5, 3]


@pytest.mark.parametrize(
    "code,want", [("600001.SH", "main"), ("688001.SH", "star"), ("300001.SZ", "chinext"), ("301001.SZ", "chinext"), ("830001.BJ", "bse")]
)
def test_board(spark, code, want):
    assert one(spark, S.board(F.lit(code))) == want


def test_limit_status_rounds_half_up(spark):
    d = lambda x: F.lit(x).cast("decimal(18,4)")
    pct = F.lit("0.10").cast("decimal(4,2)")
    assert one(spark, S.limit_status(d("11.06"), d("11.06"), d("11.06"), d("11.06"), d("10.05"), pct)) == "one_word"
    assert one(spark, S.limit_status(d("10.00"), d("11.06"), d("10.00"), d("11.06"), d("10.05"), pct)) == "limit_up"
    assert one(spark, S.open_limit_status(d("9.05"), d("10.05"), pct)) == "limit_down"


@pytest.mark.parametrize("alias,want", [("*ST甲", "st"), ("乙退", "delist"), ("退市丙", "delist"), ("丁", "normal"), (" ", "unknown"), (None, "unknown")])
def test_name_state(spark, alias, want):
    assert one(spark, S.name_state(F.lit(alias).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("09:30", 570), ("24:00", None), ("9:30", None), ("23:59", 1439), ("", None)])
def test_minutes(spark, text, want):
    assert one(spark, S.minutes(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("公司计提商誉减值准备约为1.5亿元至 20,000元", ("qualified", 1.5e8, 1.5e8, 1)), ("计提商誉减值准备为1亿元至1.2亿元", ("qualified", 1e8, 1.2e8, 1)), ("商誉减值损失金额为3000万元，商誉减值为4000万元", ("amount_conflict", None, None, 2)),
    ("计提商誉减值及无形资产减值，商誉减值准备3000万元", ("combined_unseparable", None, None, 1)), ("没有减值", ("not_quantified", None, None, 0)), (None, ("not_quantified", None, None, 0)), ("商誉减值\n准备 500 元", ("qualified", 500, 500, 1)),
    ("商誉减值为2亿元至1亿元", ("combined_unseparable", None, None, 1)),
])
def test_goodwill_evidence(spark, text, want):
    e = spark.range(1).select(T.goodwill_evidence(F.lit(text).cast("string")).alias("e")).select("e.*").first()
    assert (e.status, e.low and float(e.low), e.high and float(e.high), e.hits) == want


@pytest.mark.parametrize("title,want", [
    ("关于股东提前终止减持计划的公告", "termination"), ("关于股东减持股份预披露公告", "first_candidate"), ("股东减持股份进展公告", "progress"), ("关于股东减持完成的公告", "result"), (None, "first_candidate"),
    ("限售股锁定期届满后股东减持计划的公告", "first_candidate"), ("资管计划到期减持股份计划的公告", "first_candidate"), ("减持计划期满暨后续减持计划预披露公告", "combo_ambiguous"), ("股东累计减持股份达到2%及未来减持计划的公告", "first_with_progress"),
    ("股东减持股份达到1%的公告", "progress_reached"), ("股东减持不超过2%股份计划的公告", "first_candidate"), ("股东拟减持达到3%股份的公告", "first_candidate"), ("股东减持计划的更正公告", "revision"), ("减持股份计划延期公告", "revision"), ("减持事项到期公告", "suspect_unresolved"),
])
def test_title_class(spark, title, want):
    assert one(spark, T.reduction_title(F.lit(title).cast("string"))) == want


def test_text_fields(spark):
    assert one(spark, T.plan_ratio(F.lit("持有总股本8.08%的股东减持不超过公司总股本的2.5%"))) == 2.5
    assert one(spark, T.plan_ratio(F.lit("持有公司总股本8.08%"))) is None
    period = one(spark, T.plan_period(F.lit("减持期间：2021年3月1 日\n至2021年9月30日")))
    assert (period.start, period.end, period.kind) == ("2021-03-01", "2021-09-30", "absolute")
    assert one(spark, T.plan_period(F.lit("自本公告披露之日起3个交易日后的3个月内"))).kind == "relative"
    assert one(spark, T.plan_holder(F.lit("公司董事李小明先生计划减持"))) == "李小明" and one(spark, T.plan_holder(F.lit("股东名称：减持计划公告"))) is None
    assert one(spark, T.plan_title(F.lit("股东减持计划实施完毕"))) == "excluded:实施"
    assert [float(x) for x in one(spark, S.amounts_in_yuan(F.lit("商誉减值1.5亿元至 20,000万元")))] == [1.5e8, 2e8]
    assert [float(x) for x in one(spark, S.cash_per_ten(F.lit("每10股派发现金红利3.5元(含税)")))] == [3.5]


def test_append_only_batches_and_snapshots(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "t")
    assert readers.append_batch(df, path, 1, expect=5) == 5
    with pytest.raises(ValueError):
        readers.append_batch(df, path, 1)
    with pytest.raises(ValueError):
        readers.append_batch(df, path, 2, expect=6)
    readers.append_batch(spark.range(2), path, 3)
    assert readers.current(spark.read.parquet(path)).count() == 2
    digest = readers.canonical_digest({"t": 1, "_note": "x"})
    assert digest == readers.canonical_digest({"_other": 2, "t": 1})
    reader = readers.SnapshotReader(spark, {"t": 1}, {"t": path}, digest)
    assert reader.table("t").count() == 5
    with pytest.raises(KeyError):
        reader.table("u")
    with pytest.raises(ValueError):
        readers.SnapshotReader(spark, {"t": 3}, {"t": path}, digest)


def test_schema_drift(spark):
    with pytest.raises(ValueError):
        readers.assert_schema(spark.range(1), spark.range(1).withColumn("x", F.lit(1)).schema)


def fold_entries(rows):
    """The rule as a walk over one security's rows (d, close, h60, sum10, sum20)."""
    out, begin, streak, locked, over, under = [], None, 0, False, True, False
    for i, (d, close, high, s10, s20) in enumerate(rows):
        if high is None or close > round(high * 0.9, 6):
            begin, streak, locked = None, 0, False
            continue
        if begin is None:
            begin, over, under = i, True, False
        over, under = over and close * 10 > s10, under or close * 20 < s20
        streak = streak + 1 if close * 10 > s10 and not close * 20 < s20 and not locked else 0
        if streak == 3:
            out.append((d, rows[begin][0], over, i - begin, under))
            streak, locked = 0, True
    return out


def panel(spark, rows, kinds):
    df = spark.createDataFrame(rows, kinds)
    return df.withColumns({c: F.col(c).cast("decimal(18,4)") for c in df.columns if c in ("open", "close", "h60", "sum10", "sum20")})


def test_drawdown_entries_equal_fold(spark):
    r, rows = random.Random(2), []
    for s in range(30):
        for d in range(60):
            close = r.randrange(80, 101)
            rows.append((f"s{s}", d, close, d, 100 if d >= 5 else None, 10 * close - r.randrange(-3, 8), 20 * close - r.randrange(-2, 9)))
    df = panel(spark, rows, "sec string, d int, close int, own_idx int, h60 int, sum10 int, sum20 int")
    want = {(s, *e) for s in {x[0] for x in rows} for e in fold_entries([(x[1], x[2], *x[4:]) for x in rows if x[0] == s])}
    assert {tuple(x) for x in SEL.drawdown_entries(df).collect()} == want and len(want) > 20


def walk_path(bars, at, mode):
    """A holding path as a walk over one security's bars (cal, open, close, status, open_status, sum20)."""
    entry, n = bars[at][1], len(bars)
    stuck = lambda k: bars[k][3] == "limit_down" or bars[k][3] == "one_word" and k > 0 and bars[k][2] < bars[k - 1][2]
    opens = lambda k: bars[k][1] > 0 and bars[k][4] != "limit_down"
    if entry <= 0:
        return None
    for j in range(at, n):
        stop, mean = bars[j][2] <= entry * 0.8, j >= 19 and bars[j][2] * 20 < bars[j][5]
        if not (stop or mean):
            continue
        nominal = min(j + 1, n - 1) if mode == "next_open" else j
        k = next((k for k in range(j + 1 if mode == "next_open" else j, n) if (opens(k) if mode == "next_open" else not stuck(k))), None)
        out = n - 1 if k is None else k
        price = bars[out][2] if k is None or mode == "same_close" else bars[out][1]
        late = out - nominal
        source = "censored_close_mark" if k is None else ("next_open" if late == 0 else "postponed_open") if mode == "next_open" else ("same_close" if late == 0 else "postponed_close")
        return (j, "stop_loss" if stop else "break_ma20", stop, mean, out, price, out - at, late, bars[out][0] - bars[nominal][0], k is None, source)
    return (None, "right_censored", False, False, n - 1, bars[-1][2], n - 1 - at, 0, 0, True, "censored_close_mark")


@pytest.mark.parametrize("mode", ["next_open", "same_close"])
def test_holding_paths_equal_walk(spark, mode):
    r, rows, entries, want = random.Random(9), [], [], {}
    for s in range(40):
        close, cal, own = 100, 0, []
        for i in range(r.randrange(3, 70)):
            close, cal = max(40, close + r.randrange(-6, 6)), cal + r.choice([1, 1, 2, 30])
            own.append((cal, r.choice([close, close, close + 2, 0]), close, r.choice(["none"] * 3 + ["limit_down", "one_word"]), r.choice(["none", "limit_down"]), close * 20 + r.randrange(-30, 60)))
        rows += [(f"s{s}", c, c, o, cl, st, os, s20, i + 1) for i, (c, o, cl, st, os, s20) in enumerate(own)]
        for at in {r.randrange(len(own)) for _ in range(3)}:
            entries.append((f"s{s}:{at}", f"s{s}", own[at][0]))
            path = walk_path(own, at, mode)
            if path:
                days = [b[0] for b in own]
                want[f"s{s}:{at}"] = (None if path[0] is None else days[path[0]], *path[1:4], days[path[4]], float(path[5]), *path[6:])
    df = panel(spark, rows, "sec string, d int, cal_idx int, open int, close int, status string, open_status string, sum20 int, own_idx int")
    out = SEL.holding_paths(spark.createDataFrame(entries, "event_id string, sec string, d int"), df, mode=mode).collect()
    got = {x.event_id: (x.trigger_d, x.reason, x.by_stop, x.by_mean, x.exit_d, float(x.exit), x.held_bars, x.late_bars, x.late_days, x.censored, x.fill_source) for x in out}
    assert got == want and {x.fill_source for x in out} == {"censored_close_mark", *(("next_open", "postponed_open") if mode == "next_open" else ("same_close", "postponed_close"))}
    assert any(x.extreme for x in out)


def fold_drought(rows, share, least, days):
    """The rule as a walk over one security's rows (d, cal_idx, amount)."""
    out, prior, low, start, armed, last = [], [], 0, None, False, None
    for d, idx, amount in rows:
        if last is not None and idx != last + 1 or amount is None:
            low, start, armed = 0, None, False
        last = idx
        if amount is None:
            continue
        if len(prior) < days:
            prior.append(amount)
            continue
        total = sum(prior[-days:])
        if amount * days < share * total:
            if not low and not armed:
                start = d
            low += 1
            armed = armed or low >= least
        elif armed:
            if amount * days > total:
                out.append((d, start, low))
                low, start, armed = 0, None, False
        else:
            low, start = 0, None
        prior.append(amount)
    return out


def test_volume_drought_equals_fold(spark):
    r, rows = random.Random(4), []
    for s in range(30):
        idx = 0
        for d in range(120):
            idx += 1 if r.random() < 0.96 else 2
            rows.append((f"s{s}", d, idx, 1, 2, r.choice([10, 10, 20, 20, 60, 120]) if r.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "sec string, d int, cal_idx int, open int, close int, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    want = {(s, *e) for s in {x[0] for x in rows} for e in fold_drought([(x[1], x[2], x[5]) for x in rows if x[0] == s], 0.5, 3, 8)}
    assert {(x.sec, x.d, x.low_start, x.low_days) for x in X.volume_drought(df, share="0.50", least=3, days=8).collect()} == want and want


def test_derived_batches_need_two_computations(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    path = str(tmp_path / "derived")
    assert readers.land_derived(a, a.withColumn("v", F.col("v") + 1e-12), path, 1, keys=["k"], value="v") == 2
    for other in (a.filter("k = 1"), a.withColumn("v", F.col("v") + 1e-6), a.withColumn("v", F.lit(0.5))):
        with pytest.raises(ValueError):
            readers.land_derived(a, other, path, 2, keys=["k"], value="v")


def test_files_with_fixed_schemas(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("code string, d date, v double")
    good, bad, lines = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.jsonl"
    good.write_text("code,d,v\nx,2020-01-02,1.5\ny,,\n")
    bad.write_text("code,day,v\nx,2020-01-02,1.5\n")
    assert readers.read_csv(spark, str(good), schema).count() == 2
    with pytest.raises(Exception):
        readers.read_csv(spark, str(bad), schema).collect()
    lines.write_text('{"code": "x", "v": 1}\n{"code": "y", "v": 2}\n')
    assert readers.read_jsonl(spark, str(lines), StructType.fromDDL("code string, v long"), "code").count() == 2
    lines.write_text('{"code": "x", "v": 1}\n{"code": "x", "v": 2}\n')
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(lines), StructType.fromDDL("code string, v long"), "code")
    made = readers.evidence_manifest(spark.read.format("binaryFile").load(str(tmp_path / "*.csv")), pull_time="t")
    assert [f["name"] for f in made["files"]] == ["a.csv", "b.csv"] and len(made["digest"]) == 64


def test_study_is_a_call(spark):
    r, days, secs = random.Random(3), 420, 12
    rows, price = [], {s: 100.0 for s in range(secs)}
    for d in range(days):
        m = r.gauss(0, 0.01)
        for s in range(secs):
            price[s] *= math.exp(m + r.gauss(0, 0.01) + (0.05 if s < 6 and d == 330 + s else 0))
            if (d * 7 + s) % 50:
                rows.append((f"s{s}", d, price[s]))
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    bars = spark.createDataFrame(rows, "sec string, n int, close double").select("sec", day("n").alias("d"), *(F.col("close").cast("decimal(18,4)").alias(c) for c in ("open", "high", "low", "close")), F.lit(1).cast("decimal(18,2)").alias("amount"))
    calendar = spark.range(days).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").cast("int").alias("cal_idx"))
    events = spark.createDataFrame([(f"e{s}", f"s{s}", 329 + s, "good") for s in range(6)] + [("early", "s7", 100, "good")], "event_id string, sec string, n int, layer string").select("event_id", "sec", day("n").alias("anchor"), "layer")
    spec = E.Spec(length=3)
    one = E.run_study(bars, calendar, events, spec).first()
    assert one.n >= 5 and 0.02 < one.mean_car < 0.08 and one.n_pairs == 15 and one.spec == E.Spec(length=3).digest != E.Spec(length=4).digest
    with pytest.raises(ValueError):
        E.Spec(benchmark="pool")
