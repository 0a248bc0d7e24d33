"""Queries of event selection with its reject reasons, of holding paths and of announcement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import titles as T
from eventide.operators import returns as R
from eventide.operators import selection as X
from eventide.registry import keep, query
from eventide.sources.panel import bars, calendar, panel_sql, read

W = "OVER (PARTITION BY sec ORDER BY d)"
FROM, TO = "1996-01-01", "2000-07-01"

# Days at a limit are those on which the close moved by 30 %; days whose volume 13 divides traded at one price elsewhere.

LIMIT_SQL = f"""p AS (SELECT sec, d, cal_idx, close, vol, lag(close) {W} AS pc FROM bars JOIN cal USING (d)),
s AS (SELECT *, coalesce(close > 1.3 * pc, false) AS u0, coalesce(1.3 * close < pc, false) AS d0 FROM p),
r AS (SELECT sec, d, cal_idx, u0 OR d0 OR vol % 13 = 0 AS ow, CASE WHEN u0 THEN 'up' WHEN d0 THEN 'down' ELSE 'none' END AS oa, row_number() {W} AS seq FROM s),
ends AS (SELECT sec, min(d) AS fb, max(d) AS lb, CAST(replace(sec, 'Brand#', '') AS INTEGER) % 7 AS k FROM bars GROUP BY sec),
bad AS (SELECT sec, CASE k WHEN 0 THEN 'listing_missing' WHEN 1 THEN 'pre_listing_bar' WHEN 2 THEN 'listing_window_anomaly' END AS why FROM ends)"""


def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, k = F.lag("close").over(X.forward()), F.lit("1.3").cast("decimal(2,1)")
    up, down = F.coalesce(F.col("close") > k * prev, F.lit(False)), F.coalesce(k * F.col("close") < prev, F.lit(False))
    b = bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "d").withColumns({"u": up, "w": down})
    return b.select("sec", "d", "cal_idx", (F.col("u") | F.col("w") | (F.col("vol") % 13 == 0)).alias("one_word"), F.when(F.col("u"), "up").when(F.col("w"), "down").otherwise("none").alias("open_at"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of which some are missing, some begin after the first bar and some end with the last."""
    k = F.replace("sec", F.lit("Brand#"), F.lit("")).cast("int") % 7
    ends = bars(spark, sf_dir).groupBy("sec").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter(k != 0)
    return ends.select("sec", F.when(k == 1, F.date_add("a", 1)).otherwise(F.col("a")).alias("list_date"), F.when(k == 2, F.col("b")).alias("delist_date"))


def chain_sql(side: str, island: str = "seq") -> str:
    if side == "up":
        early = f"CASE WHEN why IS NOT NULL THEN why WHEN ev IS NULL THEN 'right_censored' WHEN ev < DATE '{FROM}' OR ev >= DATE '{TO}' THEN 'out_of_range' END"
    else:
        early = f"CASE WHEN ev IS NULL THEN 'right_censored' WHEN ev < DATE '{FROM}' THEN 'before_range' WHEN ev >= DATE '{TO}' THEN 'after_range' ELSE why END"
    hijack = "WHEN du >= 1 THEN 'reversal_hijack'" if side == "down" else ""
    count = lambda oa: f"(SELECT count(*) FROM r WHERE r.sec = f.sec AND r.seq > s1 AND (fs IS NULL OR r.seq < fs) AND ow AND oa = '{oa}')"
    return panel_sql(LIMIT_SQL + f""", m AS (SELECT *, {island} - row_number() {W} AS isl FROM r WHERE ow AND oa = '{side}'),
g AS (SELECT sec, isl, min(d) AS chain_start, max(d) AS chain_end, count(*) AS chain_len, min(seq) AS s0, max(seq) AS s1 FROM m GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT g.*, (SELECT min(seq) FROM r WHERE r.sec = g.sec AND r.seq > g.s1 AND NOT ow) AS fs FROM g),
k AS (SELECT f.*, {count('up')} AS du, {count('down')} AS dd, {count('none')} AS da FROM f),
e AS (SELECT k.*, r.d AS ev, why FROM k LEFT JOIN r ON r.sec = k.sec AND r.seq = fs LEFT JOIN bad ON bad.sec = k.sec), o AS (SELECT *, {early} AS pre FROM e)
SELECT sec, chain_start, chain_end, chain_len, s0 AS start_rank, s0 <= 30 AS recent_listing, du AS deferred_up, dd AS deferred_down, da AS deferred_anom, ev AS event_date,
  CASE WHEN pre IS NOT NULL THEN pre WHEN count(*) FILTER (pre IS NULL) OVER (PARTITION BY sec, ev) > 1 THEN 'duplicate_day' {hijack} ELSE 'event' END AS outcome FROM o""")


@query("r01_limit_open", chain_sql("up"))
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.limit_chains(keep(limit_rows(spark, sf_dir)), listings(spark, sf_dir), side="up", start=FROM, end=TO)


@query("r02_limit_down_open", chain_sql("down"))
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.limit_chains(keep(limit_rows(spark, sf_dir)), listings(spark, sf_dir), side="down", start=FROM, end=TO)


@query("r02_limit_down_by_calendar", chain_sql("down", "cal_idx"))
def r02_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.limit_chains(keep(limit_rows(spark, sf_dir)), listings(spark, sf_dir), side="down", start=FROM, end=TO, by_calendar=True)


@query("a36_funnel_conservation", f"WITH q AS ({chain_sql('down')}) SELECT count(*) AS chains, count(*) FILTER (outcome = 'event') AS events, count(*) FILTER (outcome <> 'event') AS rejects, true AS conserved FROM q")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of rows that are at the limit, counted before selection, are all events or rejected for one reason."""
    rows = keep(limit_rows(spark, sf_dir))
    out = X.limit_chains(rows, listings(spark, sf_dir), side="down", start=FROM, end=TO).agg(F.count("*").alias("chains"), F.count_if(F.col("outcome") == "event").alias("events"), F.count_if(F.col("outcome") != "event").alias("rejects"))
    # counted another way: a chain begins where a row at the limit follows one that isn't, and goes on for another row
    at = (F.col("one_word") & (F.col("open_at") == "down")).cast("int")
    w = X.forward()
    begins = rows.withColumns({"m": at, "b": F.coalesce(F.lag(at).over(w), F.lit(0)), "a": F.coalesce(F.lead(at).over(w), F.lit(0))}).filter("m = 1 and b = 0 and a = 1").agg(F.count("*").alias("begun"))
    return out.crossJoin(begins).select("chains", "events", "rejects", ((F.col("chains") == F.col("begun")) & (F.col("chains") == F.col("events") + F.col("rejects"))).alias("conserved"))  # two single rows


# Announcement titles and texts of orders: the wording goes by the price, names, numbers and dates are the order's own.

TITLES = [
    "关于持股5%以上股东减持股份计划的公告", "关于股东减持股份预披露公告", "关于控股股东减持计划的更正公告", "关于股东减持股份计划变更的公告", "关于股东提前终止减持计划的公告", "关于股东减持计划时间过半的进展公告",
    "关于股东减持股份进展公告", "关于股东减持股份结果的公告", "关于股东减持计划期限届满的公告", "关于股东减持计划期满暨后续减持计划预披露公告", "关于股东减持股份达到1%的公告", "关于股东累计减持股份达到2%及未来减持计划的公告",
    "关于股东拟减持达到3%股份的公告", "关于限售股份锁定期届满后股东减持计划的公告", "关于资产管理计划到期减持股份计划的公告", "关于股东减持不超过2%股份计划的公告", "关于董事减持股份实施完毕的公告", "关于股东增持股份计划的公告",
    "关于回购公司股份方案的公告", "关于 股东 减持\n股份计划的公告", "关于股东减持情况变更的公告", "关于股东承诺不减持公司股份的公告", "年度报告",
]
PLANS = [
    "股东名称：海南{X}投资有限公司，减持期间：2023年8月22日至2024年2月21日，拟减持不超过公司总股本的@%",
    "公司控股股东深圳市{X}集团（以下简称{X}）计划在2022年1月5日-2022年7月4日减持股份，不超过100万股，占公司总股本比例为@%",
    "公司董事李{X}先生计划自本公告披露之日起15个交易日后的6个月内减持股份不超过@%",
    "持有公司股份占总股本8.08%的股东王{X}女士减持部分股份，减持期间：2021 年 3 月 1 日\n至 2021 年 9 月 1 日",
    "本次减持计划公告之日起三个月内，监事及其一致行动人林{X}女士拟减持不超过@%",
    "股东名称：减持计划披露人，股东合计减持不超过其所持股份的@%",
]
BODIES = [
    "董事会审议通过了关于回购公司股份方案的议案，回购价格不超过人民币@元/股，回购股份用于员工持股计划", "本次回购方案经公司董事会审议通过，回购股份的价格上限为@元/股，用于注销并相应减少公司注册资本",
    "回购股份方案修订稿：董事会审议通过回购方案，回购价格不高于@元/股，为维护公司价值及股东权益", "股东大会通知，无回购", "董事会通过回购股份议案，回购价格为@元 /股，用于股权激励，部分回购股份将予以注销",
]


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in items) + "]"


def dealt(items: list[str], key: str = "o_totalprice"):
    return F.element_at(F.array(*map(F.lit, items)), (F.floor(key).cast("long") % len(items) + 1).cast("int"))


PRICE_SQL = "CAST(floor(o_totalprice) AS BIGINT)"
NUMBER_SQL = f"CAST({PRICE_SQL} // 100 % 40 / 8.0 AS DECIMAL(6,3))"


def number():
    return (F.floor(F.floor("o_totalprice") / 100) % 40 / F.lit(8)).cast("decimal(6,3)")


def titles():
    """An order's title: who, what, and of which month."""
    return F.concat(F.lit("客户"), F.col("o_custkey"), F.lit("公司"), dealt(TITLES), F.date_format("o_orderdate", "（yyyy年MM月）"))


def filled(items: list[str]):
    return F.replace(F.replace(dealt(items), F.lit("@"), number().cast("string")), F.lit("{X}"), dealt(["明华", "东方", "晨光", "海"], "o_custkey"))


def filled_sql(items: list[str]) -> str:
    return f"replace(replace({sql_list(items)}[{PRICE_SQL} % {len(items)} + 1], '@', CAST({NUMBER_SQL} AS VARCHAR)), '{{X}}', ['明华', '东方', '晨光', '海'][o_custkey % 4 + 1])"


def compact_sql(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '\s+', '', 'g')"


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def class_sql(title: str) -> str:
    t = f"regexp_replace(regexp_replace({compact_sql(title)}, '{T.LOCKUP}', '◇', 'g'), '{T.ASSET_PLAN}', '◇', 'g')"
    # the other engine has no look-behind: the words it would exclude are masked first
    reached = f"regexp_replace(regexp_replace({t}, '{T.INTENDED}', '◇', 'g'), '不超过', '不◆', 'g')"
    hit = m(reached, T.REACHED.replace("(?<!不)", ""))
    core = " OR ".join(m(t, p) for p in (T.TERMINATION, T.HALFWAY, T.PROGRESS, T.RESULT))
    return (
        f"CASE WHEN {m(t, T.REVISION)} THEN 'revision' WHEN ({core}) AND {m(t, T.NEW_PLAN)} THEN 'combo_ambiguous' WHEN {m(t, T.TERMINATION)} THEN 'termination' WHEN {m(t, T.HALFWAY)} THEN 'halfway' WHEN {m(t, T.PROGRESS)} THEN 'progress' "
        f"WHEN {m(t, T.RESULT)} THEN 'result' WHEN {hit} AND {m(t, T.PREDISCLOSED)} THEN 'first_with_progress' WHEN {hit} THEN 'progress_reached' WHEN {m(t, T.SUSPECT)} THEN 'suspect_unresolved' ELSE 'first_candidate' END"
    )


TITLE_SQL = f"('客户' || o_custkey || '公司' || {sql_list(TITLES)}[{PRICE_SQL} % {len(TITLES)} + 1] || strftime(CAST(o_orderdate AS TIMESTAMP), '（%Y年%m月）'))"


@query("p13_title_classes", f"SELECT o_orderkey, {class_sql(TITLE_SQL)} AS class FROM orders")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", T.reduction_title(titles()).alias("class"))


@query("p14_title_gate", f"""WITH t AS (SELECT o_orderkey, {TITLE_SQL} AS t FROM orders) SELECT o_orderkey, CASE WHEN NOT contains(t, '减持') THEN 'no_reduction' WHEN NOT (contains(t, '计划') OR contains(t, '预披露')) THEN 'no_plan'
  WHEN {m('t', T.GATE_EXCLUDES)} THEN 'excluded:' || regexp_extract(t, '{T.GATE_EXCLUDES}') ELSE 'pass' END AS gate FROM t""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", T.plan_title(titles()).alias("gate"))


def day_sql(x: str) -> str:
    part = lambda i, n: f"lpad(regexp_extract({x}, '([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日', {i}), {n}, '0')"
    return f"CASE WHEN {x} IS NOT NULL THEN {part(1, 4)} || '-' || {part(2, 2)} || '-' || {part(3, 2)} END"


def first_sql(patterns: tuple, group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', {group}), '')" for p in patterns) + ")"


def holder_sql() -> str:
    out = []
    for p in T.HOLDERS:
        edges, roles = T.EDGES.replace("'", "''"), T.ROLES
        name = f"regexp_replace(regexp_replace(regexp_replace(nullif(regexp_extract(t, '{p}', 1), ''), '{edges}', '', 'g'), '{roles}', ''), '^[的、 ]+|[的、 ]+$', '', 'g')"
        out.append(f"CASE WHEN length({name}) BETWEEN 2 AND 40 AND NOT regexp_matches({name}, '{T.NOT_A_HOLDER}') THEN {name} END")
    return "coalesce(" + ", ".join(out) + ")"


@query("p15_plan_fields", f"""WITH t AS (SELECT o_orderkey, {compact_sql(filled_sql(PLANS))} AS t FROM orders), x AS (SELECT o_orderkey, {holder_sql()} AS holder, CAST({first_sql(T.RATIOS)} AS DOUBLE) AS ratio,
  {first_sql(T.PERIODS, 1)} AS a, {first_sql(T.PERIODS, 2)} AS b, nullif(regexp_extract(t, '{T.RELATIVE}', 1), '') AS rel FROM t), y AS (SELECT *, {day_sql('a')} AS lo, {day_sql('b')} AS hi FROM x)
SELECT o_orderkey, holder, ratio, lo AS period_start, hi AS period_end, CASE WHEN lo IS NOT NULL THEN lo || '~' || hi ELSE rel END AS period_text, CASE WHEN lo IS NOT NULL THEN 'absolute' WHEN rel IS NOT NULL THEN 'relative' END AS period_kind,
  concat_ws(',', CASE WHEN lo IS NULL AND rel IS NULL THEN 'reduce_period' END, CASE WHEN holder IS NULL THEN 'holder_name' END, CASE WHEN ratio IS NULL THEN 'reduce_ratio_max_pct' END) AS fails FROM y""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").select("o_orderkey", filled(PLANS).alias("t"))
    x = t.select("o_orderkey", T.plan_holder(F.col("t")).alias("holder"), T.plan_ratio(F.col("t")).alias("ratio"), T.plan_period(F.col("t")).alias("p"))
    fails = T.plan_failures(F.col("holder"), F.col("ratio"), F.col("p"))
    return x.select("o_orderkey", "holder", "ratio", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.text").alias("period_text"), F.col("p.kind").alias("period_kind"), F.array_join(fails, ",").alias("fails"))


@query("p17_repurchase_evidence", f"""WITH t AS (SELECT o_orderkey, {TITLE_SQL} AS title, {compact_sql(filled_sql(BODIES))} AS t, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST({NUMBER_SQL} AS DECIMAL(18,4)) + CAST(o_orderkey % 2 AS DECIMAL(18,4)) END AS lim FROM orders),
x AS (SELECT *, {m('t', T.BOARD_FIRST)} AS initial, {m('t', T.SCHEME_REVISED)} AS revised, CAST(regexp_extract_all(t, '{T.PRICE_LIMIT}', 1) AS DECIMAL(18,4)[]) AS prices, {m('t', T.CANCELLATION)} AS a, {m('t', T.INVENTORY)} AS b, {m('t', T.OTHER_PURPOSE)} AS c FROM t)
SELECT o_orderkey, contains(title, '回购') AND NOT {m('title', T.REPURCHASE_EXCLUDES)} AS candidate, initial, revised, len(prices) AS n_prices, coalesce(list_contains(prices, lim), false) AS price_match, initial AND NOT revised AND coalesce(list_contains(prices, lim), false) AS supported,
  CASE WHEN a AND NOT b AND NOT c THEN 'cancellation' WHEN b AND NOT a AND NOT c THEN 'inventory' WHEN a OR b OR c THEN 'other_explicit' ELSE 'unclassifiable' END AS purpose FROM x""")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("o_orderkey") % 3 != 0, number().cast("decimal(18,4)") + (F.col("o_orderkey") % 2).cast("decimal(18,4)"))
    x = read(spark, sf_dir, "orders").select("o_orderkey", T.repurchase_title(titles()).alias("candidate"), T.repurchase_evidence(filled(BODIES), limit).alias("e"))
    return x.select("o_orderkey", "candidate", "e.initial", "e.revised", F.size("e.prices").cast("long").alias("n_prices"), "e.price_match", "e.supported", "e.purpose")


IMPAIRED = ["公司计提商誉减值准备约为@亿元", "预计计提商誉减值准备@万元至9000万元", "商誉减值损失@万元，此外商誉减值为7万元", "无形资产与商誉减值准备合计，商誉减值@元", "本期未计提"]


@query("p16_goodwill_evidence", f"""WITH t AS (SELECT {PRICE_SQL} % 5 AS i, CAST({NUMBER_SQL} AS DECIMAL(24,4)) AS n FROM orders), x AS (SELECT *, i = 2 AND n = 7 AS same FROM t)
SELECT CASE i WHEN 0 THEN 'qualified' WHEN 1 THEN 'qualified' WHEN 2 THEN CASE WHEN same THEN 'qualified' ELSE 'amount_conflict' END WHEN 3 THEN 'combined_unseparable' ELSE 'not_quantified' END AS status, count(*) AS docs,
  CAST(sum(CASE i WHEN 0 THEN n * 100000000 WHEN 1 THEN n * 10000 WHEN 2 THEN CASE WHEN same THEN 70000 END END) AS DECIMAL(38,4)) AS low, CAST(sum(CASE i WHEN 0 THEN n * 100000000 WHEN 1 THEN 90000000 WHEN 2 THEN CASE WHEN same THEN 70000 END END) AS DECIMAL(38,4)) AS high FROM x GROUP BY 1""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").select(T.goodwill_evidence(filled(IMPAIRED)).alias("e")).select("e.*")
    return e.groupBy("status").agg(F.count("*").alias("docs"), F.sum("low").cast("decimal(38,4)").alias("low"), F.sum("high").cast("decimal(38,4)").alias("high"))


# Every tenth order repeats the announcement of the one before, half of these under another code.

SALES_SQL = f"""a AS (SELECT o_orderkey AS seq, o_orderkey - CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS id, {TITLE_SQL} AS title, CASE WHEN o_orderkey % 20 < 10 THEN o_orderkey // 20 % 60 ELSE o_custkey % 60 END AS k,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'H' || (o_custkey % 7) END AS holder, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 31 / 10.0 END AS ratio0, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS p0,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS vt FROM orders),
l AS (SELECT k, DATE '1995-01-01' + CAST(k * 30 AS INTEGER) AS ld, CASE WHEN k % 5 = 0 THEN DATE '1995-01-01' + CAST(k * 30 + 900 AS INTEGER) END AS dd FROM (SELECT unnest(range(60)) AS k) WHERE k % 11 <> 0),
n AS (SELECT id, count(DISTINCT k) AS codes, min(seq) AS s0, CAST(arg_min(vt, seq) + INTERVAL 8 HOUR AS DATE) AS day0 FROM a GROUP BY id),
h AS (SELECT a.*, codes, s0, coalesce(day0 >= ld AND (dd IS NULL OR day0 < dd), false) AS hit FROM a JOIN n USING (id) LEFT JOIN l ON l.k = a.k), hs AS (SELECT id, count(*) FILTER (hit) AS hits FROM h GROUP BY id),
c AS (SELECT h.*, {class_sql('title')} AS cls, CASE WHEN codes = 1 AND seq > s0 THEN 'dup_announcement_id' WHEN codes > 1 AND hits <> 1 THEN 'pit_attribution_unresolved' WHEN codes > 1 AND NOT hit THEN 'pit_attribution_other_code' END AS r1 FROM h JOIN hs USING (id)),
j AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN cls NOT IN ('first_candidate', 'first_with_progress') THEN cls WHEN id % 97 = 0 THEN CASE WHEN id % 2 = 0 THEN 'same_plan_adjudicated' ELSE 'ambiguous_possible_duplicate' END
  WHEN cls = 'first_with_progress' AND id % 3 = 0 THEN 'fwp_not_adjudicated' WHEN cls = 'first_with_progress' AND id % 2 = 1 THEN 'fwp_rejected_' || CASE WHEN id % 5 = 0 THEN 'fail_closed' ELSE 'unclear' END END AS r2,
  CASE WHEN cls = 'first_with_progress' AND id % 3 <> 0 THEN 2.5 ELSE ratio0 END AS ratio FROM c),
s AS (SELECT *, CASE WHEN r2 IS NULL AND holder IS NOT NULL AND p0 IS NOT NULL THEN row_number() OVER (PARTITION BY r2 IS NULL, k, holder, p0 ORDER BY vt, CAST(id AS VARCHAR)) ELSE 1 END AS nth FROM j),
f AS (SELECT id AS announcement_id, seq, 'C' || k || '.SH' AS ts_code, cls AS class, ratio, CAST(vt + INTERVAL 8 HOUR AS DATE) AS event_date, CASE WHEN r2 IS NOT NULL THEN r2 WHEN nth > 1 THEN 'same_plan_strong_key' WHEN ratio IS NULL THEN 'ratio_unparsed_fail_closed' WHEN ratio < 1 THEN 'ratio_below_gate' END AS reason FROM s)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    k = F.when(key % 20 < 10, F.floor(key / 20) % 60).otherwise(F.col("o_custkey") % 60).cast("int")
    month = F.when(key % 6 != 0, F.trunc("o_orderdate", "month"))
    rows = o.select(
        (key - F.when(key % 10 == 1, 1).otherwise(0)).alias("announcement_id"), key.alias("seq"), titles().alias("title"), F.concat(F.lit("C"), k, F.lit(".SH")).alias("ts_code"), F.concat(F.lit("C"), k).alias("stock_code"),
        F.when(key % 9 != 0, F.concat(F.lit("H"), F.col("o_custkey") % 7)).alias("holder_name"), F.when(key % 8 != 0, key % 31 / F.lit(10.0)).alias("ratio"), month.alias("period_start"), F.add_months(month, 3).alias("period_end"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("valid_time"),
    )
    n, start = F.col("id").cast("int"), F.lit("1995-01-01").cast("date")
    listing = spark.range(60).filter("id % 11 <> 0").select(F.concat(F.lit("C"), F.col("id"), F.lit(".SH")).alias("ts_code"), F.date_add(start, n * 30).alias("list_date"), F.when(n % 5 == 0, F.date_add(start, n * 30 + 900)).alias("delist_date"))
    drops = o.filter(key % 97 == 0).select(key.alias("announcement_id"), F.when(key % 2 == 0, "same_plan_adjudicated").otherwise("ambiguous_possible_duplicate").alias("verdict"))
    passes = o.filter(key % 3 != 0).select(key.alias("announcement_id"), (key % 2 == 0).alias("ok"), F.when(key % 5 != 0, "unclear").alias("why"), F.lit(2.5).alias("new_ratio"))
    return X.holder_sales(rows, listing, drops, passes)


@query("r03_holder_sell", f"WITH {SALES_SQL} SELECT * FROM f")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir)


@query("r03_holder_sell_events", f"WITH {SALES_SQL} SELECT ts_code, event_date, count(*) AS n_ann, string_agg(CAST(announcement_id AS VARCHAR), ',' ORDER BY announcement_id) AS announcement_ids FROM f WHERE reason IS NULL GROUP BY 1, 2")
def r03_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.holder_sale_events(sales(spark, sf_dir)).withColumn("announcement_ids", F.array_join(F.col("announcement_ids").cast("array<string>"), ","))


# Lines are distributions of a brand for a quarter; the factor of a day is its volume's remainder.

EX_SQL = f"""x AS (SELECT p_brand AS sec, CASE WHEN l_partkey % 29 <> 0 THEN CAST(date_trunc('month', l_shipdate) AS DATE) END AS end_date, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_suppkey % 23 <> 0 THEN CAST(l_shipdate AS DATE) - CAST(l_suppkey % 11 AS INTEGER) END AS imp,
  CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_shipdate AS DATE) END AS rec, CAST(l_quantity % 10 / 10 AS DECIMAL(10,4)) AS bo, CASE WHEN l_quantity % 7 <> 0 THEN CAST(l_linenumber % 5 / 10.0 AS DECIMAL(10,4)) END AS co, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_partkey % 3 = 0 AND l_quantity > 25),
y AS (SELECT *, CASE WHEN l_partkey % 31 = 0 THEN bo + 1 ELSE bo + coalesce(co, 0) END AS total FROM x WHERE ex_date >= DATE '{FROM}' AND ex_date < DATE '{TO}'),
v AS (SELECT *, CASE WHEN end_date IS NULL OR imp IS NULL THEN 'required_invalid' WHEN imp >= ex_date THEN 'timing_invalid' WHEN total <> bo + coalesce(co, 0) THEN 'component_invalid' END AS bad,
  struct_pack(a := coalesce(imp, DATE '1900-01-01'), b := ex_date, c := total) AS o FROM y),
g AS (SELECT sec, end_date, count(*) AS n, arg_min(bad, o) FILTER (bad IS NOT NULL) AS bad, bool_or(imp IS NULL OR rec IS NULL OR co IS NULL) AS gaps, count(DISTINCT (ex_date, total, bo, coalesce(co, -1), coalesce(imp, DATE '1900-01-01'), coalesce(rec, DATE '1900-01-01'))) AS kinds, min(ex_date) AS ex_date, min(total) AS total FROM v GROUP BY sec, end_date),
k AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN n > 1 AND gaps THEN 'multi_null' WHEN kinds > 1 THEN 'multi_conflict' WHEN total < 0.5 THEN 'below_threshold' END AS r1 FROM g),
u AS (SELECT *, coalesce(r1, CASE WHEN count(*) FILTER (r1 IS NULL) OVER (PARTITION BY sec, ex_date) > 1 THEN 'duplicate_event_key' END) AS r2 FROM k),
c AS (SELECT d, lag(d) OVER (ORDER BY d) AS pd FROM cal), fa AS (SELECT sec, d, vol % 5 AS f FROM bars WHERE vol % 9 <> 0),
z AS (SELECT u.*, pd, a.f AS fn, a.sec IS NOT NULL AS hn, b.f AS fw, b.sec IS NOT NULL AS hw FROM u LEFT JOIN c ON c.d = u.ex_date LEFT JOIN fa a ON a.sec = u.sec AND a.d = u.ex_date LEFT JOIN fa b ON b.sec = u.sec AND b.d = pd),
ex AS (SELECT sec, end_date, ex_date, total, coalesce(r2, CASE WHEN pd IS NULL THEN 'calendar_missing' WHEN NOT hn THEN 'current_missing' WHEN NOT hw THEN 'previous_missing' WHEN fn = 0 OR fw = 0 THEN 'factor_invalid' WHEN fn = fw THEN 'factor_static' ELSE 'factor_changed' END) AS outcome, CASE WHEN fn > 0 AND fw > 0 THEN fn / CAST(fw AS DOUBLE) END AS factor_ratio FROM z)"""


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sec"))
    x = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_partkey % 3 = 0 and l_quantity > 25").join(part, "l_partkey")
    day, num = F.to_date("l_shipdate"), lambda c: c.cast("decimal(10,4)")
    x = x.select(
        "sec", F.when(F.col("l_partkey") % 29 != 0, F.trunc(day, "month")).alias("end_date"), day.alias("ex_date"), F.when(F.col("l_suppkey") % 23 != 0, F.date_sub(day, (F.col("l_suppkey") % 11).cast("int"))).alias("imp_ann_date"),
        F.when(F.col("l_suppkey") % 4 != 0, day).alias("record_date"), num(F.col("l_quantity") % 10 / 10).alias("stk_bo"), F.when(F.col("l_quantity") % 7 != 0, num(F.col("l_linenumber") % 5 / 10)).alias("stk_co"), "l_partkey",
    )
    total = F.when(F.col("l_partkey") % 31 == 0, F.col("stk_bo") + 1).otherwise(F.col("stk_bo") + F.coalesce("stk_co", F.lit(0)))
    rows = x.withColumn("stk_div", total.cast("decimal(10,4)"))
    factors = bars(spark, sf_dir).filter("vol % 9 <> 0").select("sec", "d", (F.col("vol") % 5).alias("factor"))
    return X.ex_rights(rows, factors, calendar(spark, sf_dir), start=FROM, end=TO)


@query("r10_ex_div_gap", panel_sql(EX_SQL + " SELECT sec, end_date, ex_date, total, outcome FROM ex"))
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(spark, sf_dir).drop("factor_ratio")


@query("a37_factor_ratio_audit", panel_sql(EX_SQL + " SELECT CASE WHEN ex_date < DATE '2017-01-01' THEN 'pre_2017' WHEN ex_date < DATE '2018-11-23' THEN 'enforcement_transition' ELSE 'exchange_rule_period' END AS regime, count(*) AS events, round(min(factor_ratio), 9) AS lo, round(avg(factor_ratio), 9) AS mean, round(max(factor_ratio), 9) AS hi FROM ex WHERE outcome = 'factor_changed' GROUP BY 1"))
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = distributions(spark, sf_dir).filter("outcome = 'factor_changed'")
    return x.groupBy(X.regime(F.col("ex_date")).alias("regime")).agg(F.count("*").alias("events"), *(F.round(f("factor_ratio"), 9).alias(n) for f, n in ((F.min, "lo"), (F.avg, "mean"), (F.max, "hi"))))


@query("p27_regimes", "SELECT c_custkey, CASE WHEN d < DATE '2017-01-01' THEN 'pre_2017' WHEN d < DATE '2018-11-23' THEN 'enforcement_transition' ELSE 'exchange_rule_period' END AS regime FROM (SELECT c_custkey, DATE '2016-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS d FROM customer)")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_add(F.lit("2016-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", X.regime(d).alias("regime"))


# No open can be sold at in March, April and the last months, and on days whose volume 5 divides.

PATH_SQL = f"""b AS (SELECT sec, d, cal_idx, open, close, vol, row_number() {W} AS i, lag(close) {W} AS pc, max(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS h60,
  sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s10, sum(close) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20 FROM bars JOIN cal USING (d)),
z AS (SELECT *, i >= 60 AND close <= h60 * 0.90 AS inz, close * 10 > s10 AS o10, close * 20 < s20 AS u20, month(d) IN (3, 4) OR vol % 5 = 0 OR d >= DATE '2001-08-01' AS shut, vol % 17 = 0 OR (vol % 19 = 0 AND coalesce(close < pc, false)) AS stuck FROM b),
y AS (SELECT *, i - row_number() OVER (PARTITION BY sec, inz ORDER BY d) AS ep FROM z), q AS (SELECT *, row_number() OVER (PARTITION BY sec, ep ORDER BY d) AS nth, CASE WHEN o10 AND NOT u20 THEN 1 ELSE 0 END AS g FROM y WHERE inz),
fire AS (SELECT *, sum(g) OVER (PARTITION BY sec, ep ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS f FROM q), en AS (SELECT sec, ep, min(i) AS i FROM fire WHERE f GROUP BY sec, ep),
ent AS (SELECT en.sec, q.d, en.i, (SELECT min(d) FROM q p WHERE p.sec = en.sec AND p.ep = en.ep) AS episode_start, (SELECT bool_and(o10) FROM q p WHERE p.sec = en.sec AND p.ep = en.ep AND p.i <= en.i) AS d1, q.nth - 1 AS d2, (SELECT bool_or(u20) FROM q p WHERE p.sec = en.sec AND p.ep = en.ep AND p.i <= en.i) AS d3
  FROM en JOIN q ON q.sec = en.sec AND q.i = en.i)"""


def path_sql(mode: str) -> str:
    fill = "NOT shut AND open > 0 AND z.i > tr.j" if mode == "next_open" else "NOT stuck AND z.i >= tr.j"
    price, shift = ("open", 1) if mode == "next_open" else ("close", 0)
    return PATH_SQL + f""", e0 AS (SELECT ent.sec, ent.d AS entry_d, ent.i AS e, z.open AS entry FROM ent JOIN z ON z.sec = ent.sec AND z.i = ent.i WHERE z.open > 0),
tr AS (SELECT e0.*, (SELECT min(z.i) FROM z WHERE z.sec = e0.sec AND z.i >= e AND (z.close <= entry * 0.80 OR (z.i >= 20 AND u20))) AS j, (SELECT max(i) FROM z WHERE z.sec = e0.sec) AS n FROM e0),
fi AS (SELECT tr.*, (SELECT min(z.i) FROM z WHERE z.sec = tr.sec AND {fill}) AS k FROM tr),
pa AS (SELECT fi.sec || ':' || CAST(entry_d AS VARCHAR) AS event_id, fi.sec, entry_d, entry, t.d AS trigger_d, CASE WHEN j IS NULL THEN 'right_censored' WHEN t.close <= entry * 0.80 THEN 'stop_loss' ELSE 'break_ma20' END AS reason, coalesce(t.close <= entry * 0.80, false) AS by_stop, coalesce(t.i >= 20 AND t.u20, false) AS by_mean,
  x.d AS exit_d, CASE WHEN k IS NULL THEN x.close ELSE x.{price} END AS exit, x.i - e AS held_bars, CASE WHEN j IS NULL THEN 0 ELSE x.i - least(j + {shift}, n) END AS late_bars, CASE WHEN j IS NULL THEN 0 ELSE x.cal_idx - o.cal_idx END AS late_days, k IS NULL AS censored FROM fi LEFT JOIN z t ON t.sec = fi.sec AND t.i = j JOIN z x ON x.sec = fi.sec AND x.i = coalesce(k, n) LEFT JOIN z o ON o.sec = fi.sec AND o.i = least(j + {shift}, n)),
path AS (SELECT *, late_days > 20 AS extreme, CASE WHEN censored THEN 'censored_close_mark' WHEN late_bars = 0 THEN '{'next_open' if mode == 'next_open' else 'same_close'}' ELSE '{'postponed_open' if mode == 'next_open' else 'postponed_close'}' END AS fill_source FROM pa)"""


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.moving(bars(spark, sf_dir)).join(F.broadcast(calendar(spark, sf_dir)), "d")
    few = lambda n: F.max("close").over(X.forward().rowsBetween(1 - n, 0))
    n = F.row_number().over(X.forward())
    x = x.withColumns({"own_idx": n, "h60": F.when(n >= 60, few(60))})
    shut = F.month("d").isin(3, 4) | (F.col("vol") % 5 == 0) | (F.col("d") >= F.lit("2001-08-01").cast("date"))
    status = F.when(F.col("vol") % 17 == 0, "limit_down").when(F.col("vol") % 19 == 0, "one_word").otherwise("none")
    return keep(x.withColumns({"open_status": F.when(shut, "limit_down").otherwise("none"), "status": status}))


def paths(rows: DataFrame, mode: str) -> DataFrame:
    entries = X.drawdown_entries(rows).select(F.concat_ws(":", "sec", F.col("d").cast("string")).alias("event_id"), "sec", "d")
    return X.holding_paths(entries, rows, mode=mode)


@query("r14_drawdown_rebuy", panel_sql(PATH_SQL + " SELECT sec, d, episode_start, d1, d2, d3 FROM ent"))
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drawdown_entries(path_rows(spark, sf_dir))


@query("a28_drawdown_diagnostics", panel_sql(PATH_SQL + " SELECT count(*) AS n, count(*) FILTER (d1) AS d1_count, count(*) FILTER (d3) AS d3_count, min(d2) AS d2_min, max(d2) AS d2_max, round(avg(d2), 9) AS d2_mean, median(d2) AS d2_median FROM ent"))
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.drawdown_entries(path_rows(spark, sf_dir))
    return e.agg(
        F.count("*").alias("n"), F.count_if("d1").alias("d1_count"), F.count_if("d3").alias("d3_count"), F.min("d2").alias("d2_min"), F.max("d2").alias("d2_max"), F.round(F.avg("d2"), 9).alias("d2_mean"), F.median("d2").alias("d2_median")
    )


@query("e20_holding_path", panel_sql(path_sql("next_open") + " SELECT * FROM path"))
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(path_rows(spark, sf_dir), "next_open")


@query("e20_holding_path_same_close", panel_sql(path_sql("same_close") + " SELECT * FROM path"))
def e20_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(path_rows(spark, sf_dir), "same_close")


@query("a27_exit_diagnostics", panel_sql(path_sql("next_open") + """ SELECT reason, fill_source, count(*) AS n, count(*) FILTER (by_stop AND by_mean) AS both, count(*) FILTER (late_bars > 0) AS postponed, count(*) FILTER (extreme) AS extreme, round(avg(held_bars), 9) AS mean_held,
  round(avg(CAST(exit AS DOUBLE) * (1 - 0.00225) / (CAST(entry AS DOUBLE) * 1.00125) - 1), 9) AS mean_net, round(median(CAST(exit AS DOUBLE) / CAST(entry AS DOUBLE) - 1), 9) AS median_gross FROM path GROUP BY 1, 2"""))
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(path_rows(spark, sf_dir), "next_open")
    entry, exit_ = F.col("entry").cast("double"), F.col("exit").cast("double")
    return p.groupBy("reason", "fill_source").agg(
        F.count("*").alias("n"), F.count_if(F.col("by_stop") & F.col("by_mean")).alias("both"), F.count_if(F.col("late_bars") > 0).alias("postponed"), F.count_if("extreme").alias("extreme"), F.round(F.avg("held_bars"), 9).alias("mean_held"),
        F.round(F.avg(exit_ * (1 - 0.00225) / (entry * 1.00125) - 1), 9).alias("mean_net"), F.round(F.median(exit_ / entry - 1), 9).alias("median_gross"),
    )


STRATEGY_SQL = path_sql("next_open") + f""", rr AS (SELECT sec, d, ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) {W} AS DOUBLE)) AS ret FROM bars), mk AS (SELECT cal_idx, avg(ret) AS rm FROM rr JOIN cal USING (d) WHERE ret IS NOT NULL AND cal_idx % 211 <> 7 GROUP BY cal_idx),
sdv AS (SELECT sec, CASE WHEN CAST(replace(sec, 'Brand#', '') AS INTEGER) % 6 = 0 THEN 0 ELSE stddev_samp(ret) END AS sd FROM rr GROUP BY sec),
w1 AS (SELECT path.*, ca.cal_idx AS i0, cb.cal_idx AS i1, sd FROM path JOIN cal ca ON ca.d = entry_d JOIN cal cb ON cb.d = exit_d JOIN sdv USING (sec)),
w2 AS (SELECT w1.*, (SELECT CASE WHEN count(rm) = i1 - i0 + 1 THEN exp(sum(rm)) - 1 END FROM mk WHERE cal_idx BETWEEN i0 AND i1) AS bench, CAST(exit AS DOUBLE) / CAST(entry AS DOUBLE) - 1 AS gross, CAST(exit AS DOUBLE) * (1 - 0.00225) / (CAST(entry AS DOUBLE) * 1.00125) - 1 AS net FROM w1),
st AS (SELECT *, i1 - i0 + 1 AS held_days, net - bench AS bhar, gross - bench AS bhar_gross, CASE WHEN sd > 0 THEN (gross - bench) / (sd * sqrt(i1 - i0 + 1)) END AS sbhar_gross, CASE WHEN bench IS NULL THEN 'bench_gap' WHEN sd <= 0 THEN 'sbhar_none' END AS excluded FROM w2)"""


def run_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal, b = calendar(spark, sf_dir), bars(spark, sf_dir)
    r = keep(R.gap_returns(b).join(F.broadcast(cal), "d").select("sec", "cal_idx", "ret"))
    market = r.filter("ret is not null and cal_idx % 211 <> 7").groupBy("cal_idx").agg(F.avg("ret").alias("rm"))
    p = keep(paths(path_rows(spark, sf_dir), "next_open"))
    none = F.replace("sec", F.lit("Brand#"), F.lit("")).cast("int") % 6 == 0
    sd = r.groupBy("sec").agg(F.stddev_samp("ret").alias("v")).select("sec", F.when(none, 0.0).otherwise(F.col("v")).alias("sd"))
    return X.strategy(p, market, cal, p.select("event_id", "sec").join(sd, "sec").select("event_id", "sd"))


@query("e22_strategy_returns", panel_sql(STRATEGY_SQL + " SELECT event_id, held_days, round(gross, 8) AS gross, round(net, 8) AS net, round(bench, 8) AS bench, round(bhar, 8) AS bhar, round(bhar_gross, 8) AS bhar_gross, round(sbhar_gross, 8) AS sbhar_gross, excluded FROM st"))
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_strategy(spark, sf_dir).select("event_id", "held_days", *(F.round(c, 8).alias(c) for c in ("gross", "net", "bench", "bhar", "bhar_gross", "sbhar_gross")), "excluded")


@query("e22_strategy_tests", panel_sql(STRATEGY_SQL + """, k AS (SELECT * FROM st WHERE excluded IS NULL), g AS (SELECT count(*) AS n, avg(bhar_gross) AS mu, stddev_samp(bhar_gross) AS s, avg(sbhar_gross) AS zm, stddev_samp(sbhar_gross) AS zs FROM k),
h AS (SELECT sum(power(bhar_gross - mu, 3)) / (max(n) * power(max(s), 3)) AS sk FROM k CROSS JOIN g)
SELECT n, (SELECT count(*) FROM st WHERE excluded = 'bench_gap') AS bench_gap, (SELECT count(*) FROM st WHERE excluded = 'sbhar_none') AS sbhar_none, round(mu, 8) AS mean_bhar, round(zm / zs * sqrt(n), 7) AS z, round(sk, 6) AS skew,
  round(sqrt(n) * (mu / s + sk * power(mu / s, 2) / 3 + sk * sk * power(mu / s, 3) / 27 + sk / (6 * n)), 6) AS t_sa FROM g CROSS JOIN h"""))
def e22_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("excluded").isNull()
    own = lambda c: F.when(x, F.col(c))
    g = run_strategy(spark, sf_dir).agg(
        F.count_if(x).alias("n"), F.count_if(F.col("excluded") == "bench_gap").alias("bench_gap"), F.count_if(F.col("excluded") == "sbhar_none").alias("sbhar_none"), F.avg(own("bhar_gross")).alias("mu"), F.stddev_samp(own("bhar_gross")).alias("s"),
        F.avg(own("sbhar_gross")).alias("zm"), F.stddev_samp(own("sbhar_gross")).alias("zs"), F.skewness(own("bhar_gross")).alias("sk"),
    )
    n = F.col("n").cast("double")
    g = g.withColumns({"q": F.col("mu") / F.col("s"), "k": F.col("sk") * F.pow((n - 1) / n, F.lit(1.5))})
    q, k = F.col("q"), F.col("k")
    t = F.sqrt(n) * (q + k * q * q / 3 + k * k * q * q * q / 27 + k / (6 * n))
    return g.select("n", "bench_gap", "sbhar_none", F.round("mu", 8).alias("mean_bhar"), F.round(F.col("zm") / F.col("zs") * F.sqrt(n), 7).alias("z"), F.round("k", 6).alias("skew"), F.round(t, 6).alias("t_sa"))
