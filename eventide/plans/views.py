"""Reader views over batch-versioned snapshot tables (S02-S17), keyed scans, and the ledger's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import returns as R
from eventide.registry import query
from eventide.sources import readers
from eventide.sources.panel import bars, calendar, first_events, panel_sql, read

# Orders are facts in three batches; their days lie 24 years later, so that some are behind the holdout.
FACTS_SQL = """f AS (SELECT o_orderkey AS k, o_custkey AS c, lpad(CAST(o_custkey % 300 AS VARCHAR), 6, '0') || ['.SH', '.SZ', '.BJ', '.HK'][o_custkey % 4 + 1] AS ts_code,
  CAST(o_orderdate + INTERVAL 24 YEAR AS DATE) AS day, o_orderkey % 3 + 1 AS batch_id, o_totalprice AS v FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    suffix = F.element_at(F.array(*map(F.lit, (".SH", ".SZ", ".BJ", ".HK"))), (c % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), c.alias("c"), F.concat(F.lpad((c % 300).cast("string"), 6, "0"), suffix).alias("ts_code"), F.add_months(F.to_date("o_orderdate"), 288).alias("day"),
        (F.col("o_orderkey") % 3 + 1).alias("batch_id"), F.col("o_totalprice").alias("v"),
    )


#: For each view the snapshot table's columns over the facts, the dates that the holdout guards, the suffix rule and a condition.
VIEWS = {
    "s06_listing": (["ts_code", "CASE WHEN k % 5 = 0 THEN 'D' ELSE 'L' END AS list_status", "day AS list_date", "CASE WHEN k % 5 = 0 THEN day + 100 END AS delist_date"], [], None, None),
    "s07_forecast": (["ts_code", "day AS ann_date", "day - 30 AS end_date", "day - 10 AS first_ann_date", "CASE WHEN k % 7 <> 0 THEN v / 1000 END AS p_change_min", "v / 900 AS p_change_max"], ["ann_date"], "not_bj", None),
    "s08_namechange": (["ts_code", "'N' || CAST(k AS STRING) AS alias", "day AS start_date", "CASE WHEN k % 4 <> 0 THEN day - 3 END AS ann_date", "CASE WHEN k % 6 = 0 THEN 'cn' ELSE 'name' END AS alias_type"], ["ann_date"], "not_bj", "alias_type = 'name'"),
    "s09_index_daily": (["day AS trade_date", "v AS close", "CASE WHEN k % 9 = 0 THEN 'CNY' ELSE 'USD' END AS currency"], ["trade_date"], None, None),
    "s09_index_member": (["CASE WHEN k % 2 = 0 THEN '801081.SI' ELSE '801080.SI' END AS index_code", "ts_code", "day AS in_date", "CASE WHEN k % 3 <> 0 THEN day + 400 END AS out_date"], [], None, "index_code = '801081.SI'"),
    "s10_raw_bar": (["ts_code", "day AS trade_date", "v AS open", "v + 1 AS close", "v * 10 AS amount"], ["trade_date"], "not_bj", None),
    "s11_express": (["ts_code", "day AS ann_date", "day - 60 AS end_date", "v AS n_income", "CAST(k % 2 AS STRING) AS update_flag"], ["ann_date"], "not_bj", None),
    "s11_audit": (["ts_code", "day AS ann_date", "day - 90 AS end_date", "CASE WHEN k % 10 = 0 THEN 'qualified' ELSE 'clean' END AS audit_result", "v AS audit_fees"], ["ann_date"], "not_bj", None),
    "s11_dividend": (["ts_code", "day - 20 AS end_date", "day AS ann_date", "CASE WHEN k % 3 = 0 THEN 'plan' ELSE 'done' END AS div_proc", "v / 10 AS cash_div_tax"], ["ann_date"], "not_bj", None),
    "s11_repurchase": (["ts_code", "day AS ann_date", "CASE WHEN k % 4 = 0 THEN 'done' ELSE 'plan' END AS proc", "v AS amount", "v / 100 AS high_limit"], ["ann_date"], "sh_sz", None),
    "s11_ex_div": (["ts_code", "CASE WHEN k % 5 <> 0 THEN day END AS ex_date", "v / 1000 AS stk_div"], ["ex_date"], "sh_sz", None),
    "s11_adj_factor": (["ts_code", "day AS trade_date", "v / 500 AS adj_factor"], ["trade_date"], "sh_sz", None),
    "s11_balance_sheet": (["ts_code", "day AS ann_date", "CASE WHEN k % 3 = 0 THEN day + 20 END AS f_ann_date", "coalesce(CASE WHEN k % 3 = 0 THEN day + 20 END, day) AS known_date", "v AS goodwill"], ["known_date"], "sh_sz", None),
}


def names_of(columns: list[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[-1] for c in columns]


def shown(columns: list[str]) -> list[str]:
    return [n for n in names_of(columns) if n not in ("alias_type", "known_date")]


def view_sql(name: str, batch: str = "(SELECT max(batch_id) FROM s)") -> str:
    columns, dates, suffix, where = VIEWS[name]
    null = "OR {d} IS NULL" if name == "s08_namechange" else ""
    rules = [f"batch_id = {batch}", *(f"({d} < DATE '2024-07-01' {null.format(d=d)})" for d in dates)]
    if suffix:
        rules.append("right(ts_code, 3) <> '.BJ'" if suffix == "not_bj" else "right(ts_code, 3) IN ('.SH', '.SZ')")
    if where:
        rules.append(where)
    return f"WITH {FACTS_SQL}, s AS (SELECT {', '.join(columns)}, batch_id FROM f) SELECT {', '.join(shown(columns))}, 'batch' || batch_id AS snapshot_batch FROM s WHERE {' AND '.join(rules)}".replace("AS STRING", "AS VARCHAR")


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return facts(spark, sf_dir).selectExpr(*VIEWS[name][0], "batch_id")


def view(spark: SparkSession, sf_dir: str, name: str, batch: int | None = None) -> DataFrame:
    columns, dates, suffix, where = VIEWS[name]
    return readers.reader_view(snapshot(spark, sf_dir, name), shown(columns), batch=batch, dates=tuple(dates), null_passes=name == "s08_namechange", suffix=suffix, where=where)


def view_query(name: str):
    return lambda spark, sf_dir: view(spark, sf_dir, name)


for _name in VIEWS:
    _run = view_query(_name)
    _run.__name__ = f"{_name}_view"
    query(f"{_name}_view", view_sql(_name))(_run)


@query("s12_pinned_views", " UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n, min(snapshot_batch) AS snapshot_batch FROM ({view_sql(n, '2')})" for n in VIEWS))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view pinned to batch 2: the same code path with another batch."""
    out = None
    for name in VIEWS:
        one = view(spark, sf_dir, name, 2).agg(F.lit(name).alias("view"), F.count("*").alias("n"), F.min("snapshot_batch").alias("snapshot_batch"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s05_holder_sell_view", f"""WITH {FACTS_SQL}, s AS (SELECT ts_code, k AS announcement_id, CAST(day AS TIMESTAMP) + to_hours(CAST(k % 24 AS INTEGER)) AS valid_time, batch_id FROM f), t AS (SELECT *, CAST(valid_time + INTERVAL 8 HOUR AS DATE) AS ann_date_bj FROM s)
SELECT ts_code, announcement_id, ann_date_bj, 'batch' || batch_id AS snapshot_batch FROM t WHERE batch_id = (SELECT max(batch_id) FROM t) AND ann_date_bj < DATE '2024-07-01' AND ts_code NOT LIKE '%.BJ'""")
def s05_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("day").cast("timestamp") + F.make_dt_interval(hours=(F.col("k") % 24).cast("int"))
    t = facts(spark, sf_dir).select("ts_code", F.col("k").alias("announcement_id"), S.beijing_date(at).alias("ann_date_bj"), "batch_id")
    return readers.reader_view(t, ["ts_code", "announcement_id", "ann_date_bj"], dates=("ann_date_bj",), suffix="not_bj")


@query("s16_date_list_scan", panel_sql("SELECT sec, d, close FROM bars WHERE d IN (SELECT DISTINCT anchor FROM ev WHERE layer = 'good')"))
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = first_events(spark, sf_dir).filter("layer = 'good'").select(F.col("anchor").alias("d")).distinct()
    return bars(spark, sf_dir).join(F.broadcast(days), "d", "left_semi").select("sec", "d", "close")  # days: a bounded axis


@query("s17_strict_prior_reader", f"""WITH {FACTS_SQL}, e AS (SELECT * FROM f WHERE batch_id = 3 AND k % 2 = 0), p AS (SELECT * FROM f WHERE batch_id = 3 AND k % 2 = 1)
SELECT e.k, e.ts_code, e.day, (SELECT max(p.day) FROM p WHERE p.ts_code = e.ts_code AND p.day < e.day) AS prior_day FROM e""")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with the latest forecast day strictly before it."""
    f = facts(spark, sf_dir).filter("batch_id = 3")
    w = Window.partitionBy("ts_code").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    x = f.withColumn("prior_day", F.max(F.when(F.col("k") % 2 == 1, F.col("day"))).over(w))
    return x.filter("k % 2 = 0").select("k", "ts_code", "day", "prior_day")


@query("j02_entity_left_join", f"""WITH {FACTS_SQL}, m AS (SELECT DISTINCT lpad(CAST(c_custkey % 300 AS VARCHAR), 6, '0') AS code6, CASE WHEN c_custkey % 300 % 7 = 0 THEN ' NaN ' ELSE 'IND' || (c_custkey % 300 % 12) END AS ind FROM customer WHERE c_custkey % 300 % 11 <> 0)
SELECT k, ts_code, CASE WHEN ind IS NULL OR lower(trim(ind)) = 'nan' THEN 'unknown' ELSE ind END AS industry FROM f LEFT JOIN m ON m.code6 = left(ts_code, 6)""")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 300
    m = read(spark, sf_dir, "customer").filter(n % 11 != 0).select(F.lpad(n.cast("string"), 6, "0").alias("code6"), F.when(n % 7 == 0, " NaN ").otherwise(F.concat(F.lit("IND"), n % 12)).alias("ind")).distinct()
    f = facts(spark, sf_dir).withColumn("code6", F.left("ts_code", F.lit(6)))
    return f.join(m, "code6", "left").select("k", "ts_code", S.norm_industry(F.col("ind")).alias("industry"))


@query("s02_adjusted_view", panel_sql("""fa AS (SELECT sec, d, CAST(1 + (vol % 7) * 0.1 AS DECIMAL(4,1)) AS f FROM bars WHERE vol % 5 <> 0), ii AS (SELECT sec, 'I' || (length(sec) + ascii(right(sec, 1))) % 3 AS ind FROM (SELECT DISTINCT sec FROM bars) WHERE sec <> 'Brand#3')
SELECT b.sec, b.d, cal_idx, CAST(close * f AS DECIMAL(24,5)) AS adj_close, CAST(open * f AS DECIMAL(24,5)) AS adj_open, coalesce(ind, 'unknown') AS industry FROM bars b JOIN fa USING (sec, d) JOIN cal USING (d) LEFT JOIN ii ON ii.sec = b.sec WHERE d < DATE '2024-07-01' AND cal_idx % 10 <> 3"""))
def s02_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted prices on open days (a tenth of the days are closed here, and their bars drop), with the industry of the entity master."""
    from eventide.sources.panel import industry

    b = bars(spark, sf_dir)
    factor = b.filter("vol % 5 <> 0").select("sec", "d", (1 + (F.col("vol") % 7) * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(4,1)").alias("f"))
    open_days = readers.before_holdout(calendar(spark, sf_dir).filter("cal_idx % 10 <> 3"), "d")
    master = b.select("sec").distinct().filter("sec <> 'Brand#3'").select("sec", industry(F.col("sec")).alias("ind"))
    x = b.join(factor, ["sec", "d"]).join(F.broadcast(open_days), "d").join(master, "sec", "left")
    return x.select("sec", "d", "cal_idx", *((F.col(c) * F.col("f")).cast("decimal(24,5)").alias(f"adj_{c}") for c in ("close", "open")), S.norm_industry(F.col("ind")).alias("industry"))


KINDS = (("预增", "p > 0 AND v > 1.5 * p"), ("略增", "p > 0 AND v > 1.02 * p"), ("续盈", "p > 0 AND v > 0.98 * p"), ("扭亏", "p <= 0 AND v > 0"), ("预减", "p > 0 AND v > 0 AND v < 0.5 * p"), ("略减", "p > 0 AND v > 0"), ("首亏", "p > 0 AND v <= 0"), ("续亏", "p <= 0 AND v <= 0"))


@query("p08_layers", f"""WITH x AS (SELECT event_id, value - 60 AS v, lag(value - 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
k AS (SELECT event_id, CASE {' '.join(f"WHEN {when} THEN '{kind}'" for kind, when in KINDS)} ELSE '不确定' END AS kind FROM x)
SELECT event_id, kind, CASE WHEN kind IN ('预增', '略增', '续盈') THEN 'good' WHEN kind = '扭亏' THEN 'turnaround' ELSE 'bad' END AS layer FROM k WHERE kind <> '不确定'""")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's value is called beside the one before (60 is the loss line), and the layer that the word belongs to."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = read(spark, sf_dir, "events").withColumn("v", F.col("value") - 60).withColumn("p", F.lag("v").over(w))
    kind = F.coalesce(*(F.when(F.expr(when), kind) for kind, when in KINDS), F.lit("不确定"))
    return x.select("event_id", kind.alias("kind")).withColumn("layer", S.layer(F.col("kind"))).filter("layer is not null")


NAME_SQL = """CASE WHEN c_acctbal BETWEEN 0 AND 200 THEN NULL WHEN c_acctbal BETWEEN 200 AND 400 THEN '  ' ELSE CASE WHEN c_acctbal < -800 THEN '*ST' WHEN c_acctbal < -600 THEN 'S*ST ' WHEN c_acctbal < -300 THEN 'ST ' WHEN c_acctbal < 0 THEN 'SST' WHEN c_acctbal > 9500 THEN '退市' ELSE '' END
  || substr(c_mktsegment, 1, 4) || right(c_name, 3) || CASE WHEN c_acctbal BETWEEN 9000 AND 9500 OR c_acctbal < -900 THEN '退' ELSE '' END END"""


@query("p12_name_states", f"""WITH t AS (SELECT c_custkey, {NAME_SQL} AS a FROM customer)
SELECT c_custkey, a AS name, CASE WHEN a IS NULL OR trim(a) = '' THEN 'unknown' WHEN starts_with(trim(a), '退市') OR right(trim(a), 1) = '退' THEN 'delist' WHEN contains(a, 'ST') THEN 'st' ELSE 'normal' END AS state, coalesce(contains(a, '*ST'), false) AS star FROM t""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of each customer's segment, number and marks that go by the balance, and the states that they say."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.expr(NAME_SQL).alias("name"))
    return rows.select("c_custkey", "name", S.name_state(F.col("name")).alias("state"), F.coalesce(S.has_star(F.col("name")), F.lit(False)).alias("star"))


@query("p11_regime_segments", f"WITH {FACTS_SQL} SELECT CASE WHEN day < DATE '2020-08-24' THEN 'pre_10pct' ELSE 'post_20pct' END AS segment, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM f GROUP BY 1")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(S.regime_segment(F.col("day")).alias("segment")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("p18_cash_per_ten", r"""WITH t AS (SELECT o_orderkey, replace(['每10股派发现金红利@元（含税）', '每 10 股派@元，另每10股转增3股', '每10股派送 5.5元；中期每10股派@元', '不分配'][CAST(floor(o_totalprice) AS BIGINT) % 4 + 1], '@', CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) // 10 % 50 / 8.0 AS DECIMAL(6,3)) AS VARCHAR)) AS t FROM orders),
x AS (SELECT o_orderkey, CAST(regexp_extract_all(t, '每\s*10\s*股[^0-9]{0,12}([0-9]+(?:\.[0-9]+)?)\s*元', 1) AS DECIMAL(18,4)[]) AS v FROM t) SELECT o_orderkey, len(v) AS n, list_sum(v) AS total FROM x""")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, ("每10股派发现金红利@元（含税）", "每 10 股派@元，另每10股转增3股", "每10股派送 5.5元；中期每10股派@元", "不分配")))
    price = F.floor("o_totalprice").cast("long")
    number = (F.floor(price / 10) % 50 / F.lit(8)).cast("decimal(6,3)").cast("string")
    v = S.cash_per_ten(F.replace(F.element_at(texts, (price % 4 + 1).cast("int")), F.lit("@"), number))
    x = read(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return x.select("o_orderkey", F.size("v").cast("long").alias("n"), F.when(F.size("v") > 0, F.aggregate("v", F.lit(0).cast("decimal(24,4)"), lambda a, b: (a + b).cast("decimal(24,4)"))).alias("total"))


@query("p22_study_ranges", f"WITH {FACTS_SQL} SELECT start, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM f JOIN (VALUES (DATE '2019-07-01'), (DATE '2021-01-01'), (DATE '2023-01-01')) r(start) ON day >= start AND day < DATE '2024-07-01' GROUP BY start")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open ranges of three studies: a fact belongs to each that has begun."""
    starts = F.array(*(F.lit(s).cast("date") for s in ("2019-07-01", "2021-01-01", "2023-01-01")))
    x = facts(spark, sf_dir).filter("day < date'2024-07-01'").withColumn("start", F.explode(F.filter(starts, lambda s: s <= F.col("day"))))
    return x.groupBy("start").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("p23_annual_rows", f"WITH {FACTS_SQL}, a AS (SELECT k, CASE WHEN k % 4 = 0 THEN make_date(year(day), 12, 31) ELSE day END AS end_date FROM f) SELECT k, end_date FROM a WHERE strftime(end_date, '%m%d') = '1231'")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("k") % 4 == 0, F.make_date(F.year("day"), F.lit(12), F.lit(31))).otherwise(F.col("day"))
    return facts(spark, sf_dir).select("k", end.alias("end_date")).filter((F.month("end_date") == 12) & (F.day("end_date") == 31))


@query("p24_text_recall", "SELECT doc_id, text ILIKE '%licensed under%' AS license FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%PASSWORD%'")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter(F.col("text").ilike("%license%") | F.col("text").ilike("%PASSWORD%"))
    return d.select("doc_id", F.col("text").ilike("%licensed under%").alias("license"))


@query("j09_prior_denominator_versions", f"""WITH {FACTS_SQL}, b AS (SELECT ts_code, date_trunc('quarter', day)::DATE AS qd, CAST(k % 6 AS INTEGER) AS eq FROM f WHERE batch_id <> 1), q AS (SELECT ts_code, qd, count(DISTINCT eq) AS versions, min(eq) AS eq FROM b GROUP BY 1, 2), e AS (SELECT k, ts_code, day FROM f WHERE batch_id = 1),
l AS (SELECT e.*, (SELECT max(qd) FROM q WHERE q.ts_code = e.ts_code AND q.qd + INTERVAL 3 MONTH <= day) AS qd FROM e) SELECT k, l.qd AS quarter, CASE WHEN l.qd IS NULL THEN 'missing' WHEN versions > 1 THEN 'conflict' WHEN eq <= 0 THEN 'nonpositive' ELSE 'ok' END AS status, CASE WHEN versions = 1 AND eq > 0 THEN eq END AS denominator FROM l LEFT JOIN q ON q.ts_code = l.ts_code AND q.qd = l.qd""")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest quarter known before an event; versions of it that differ are a conflict."""
    f = facts(spark, sf_dir)
    q = f.filter("batch_id <> 1").groupBy("ts_code", F.trunc("day", "quarter").alias("quarter")).agg(F.count_distinct(F.col("k") % 6).alias("versions"), F.min((F.col("k") % 6).cast("int")).alias("eq"))
    known = q.select("ts_code", F.add_months("quarter", 3).alias("t"), F.struct("quarter", "versions", "eq").alias("x"), F.lit(None).cast("long").alias("k"), F.lit(0).alias("o"))
    ev = f.filter("batch_id = 1").select("ts_code", F.col("day").alias("t"), F.lit(None).cast(known.schema["x"].dataType).alias("x"), F.col("k").cast("long").alias("k"), F.lit(1).alias("o"))
    w = Window.partitionBy("ts_code").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    x = known.unionByName(ev).withColumn("last", F.last("x", ignorenulls=True).over(w)).filter("o = 1")
    status = F.when(F.col("last").isNull(), "missing").when(F.col("last.versions") > 1, "conflict").when(F.col("last.eq") <= 0, "nonpositive").otherwise("ok")
    return x.select("k", F.col("last.quarter").alias("quarter"), status.alias("status"), F.when(status == "ok", F.col("last.eq")).alias("denominator"))


@query("j12_orphans", f"WITH {FACTS_SQL} SELECT k, ts_code FROM f WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = f.c AND c_nationkey % 5 <> 0)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = read(spark, sf_dir, "customer").filter("c_nationkey % 5 <> 0").select(F.col("c_custkey").alias("c"))
    return facts(spark, sf_dir).join(master, "c", "left_anti").select("k", "ts_code")


@query("j20_digest_mismatches", "SELECT e.event_type AS source, count(*) AS n, count(*) FILTER (sha256(e.props) <> a.sha) AS mismatches FROM events e JOIN (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN sha256(props || ' ') ELSE sha256(props) END AS sha FROM events WHERE event_id % 3 = 0) a USING (event_id) GROUP BY 1")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addenda carry the digest of what they amend; a thirteenth of these don't match any more."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    a = e.filter("event_id % 3 = 0").select("event_id", F.sha2(F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256).alias("sha"))
    return e.join(a, "event_id").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.sha2("props", 256) != F.col("sha")).alias("mismatches"))


@query("a39_key_set_equality", f"""WITH {FACTS_SQL}, d AS (SELECT ts_code, list_sort(list(DISTINCT k % 9)) AS ks FROM f WHERE batch_id = 1 GROUP BY 1), m AS (SELECT ts_code, list_sort(list(DISTINCT k % 9)) AS ks FROM f WHERE batch_id = 2 GROUP BY 1)
SELECT coalesce(d.ts_code, m.ts_code) AS ts_code, d.ks IS NOT NULL AND m.ks IS NOT NULL AND d.ks = m.ks AS same FROM d FULL JOIN m ON d.ts_code = m.ts_code""")
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two batches hold the same keys for a code; nine keys at most."""
    keys = lambda batch, name: facts(spark, sf_dir).filter(F.col("batch_id") == batch).groupBy("ts_code").agg(F.sort_array(F.collect_set(F.col("k") % 9)).alias(name))
    return keys(1, "a").join(keys(2, "b"), "ts_code", "full").select("ts_code", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


@query("u03_union_of_selections", panel_sql("SELECT sec, d, 'up' AS kind FROM bars WHERE close > open UNION ALL SELECT sec, d, 'down' FROM bars WHERE close < open UNION ALL SELECT sec, d, 'wide' FROM bars WHERE high > 2 * low"))
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections over one scan, as one row per selection that a bar is in."""
    kinds = F.array_compact(F.array(F.when(F.col("close") > F.col("open"), "up"), F.when(F.col("close") < F.col("open"), "down"), F.when(F.col("high") > F.col("low") * 2, "wide")))
    return bars(spark, sf_dir).select("sec", "d", F.explode(kinds).alias("kind"))


@query("u04_dual_computation", panel_sql("""r AS (SELECT sec, d, ln(CAST(close AS DOUBLE)) - ln(CAST(lag(close) OVER (PARTITION BY sec ORDER BY d) AS DOUBLE)) AS ret FROM bars), m AS (SELECT d, avg(ret) AS a, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY d),
x AS (SELECT d, a, n, CASE WHEN dayofyear(d) = 100 THEN a + 0.001 ELSE a END AS b, CASE WHEN dayofyear(d) = 200 THEN n + 1 ELSE n END AS k FROM m WHERE dayofyear(d) <> 300)
SELECT (SELECT count(*) FROM m) AS days, (SELECT count(*) FROM m) - (SELECT count(*) FROM x) AS only_one, (SELECT count(*) FROM x WHERE abs(a - b) >= 1e-9) AS n_apart, (SELECT count(*) FROM x WHERE n <> k) AS n_mismatch"""))
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two computations of the market return: by windows, and by joining each bar with the one before; the second is disturbed on some days, which the gate must count."""
    b = bars(spark, sf_dir)
    one = R.market_return(R.gap_returns(b))
    n = b.withColumn("i", F.row_number().over(R.by_sec()))
    before = n.select("sec", (F.col("i") + 1).alias("i"), F.col("close").alias("prev"))
    two = n.join(before, ["sec", "i"]).groupBy("d").agg(F.avg(R.log_ratio("close", "prev")).alias("b"), F.count("*").alias("m")).filter("dayofyear(d) <> 300")
    day = F.dayofyear("d")
    two = two.select("d", F.when(day == 100, F.col("b") + 0.001).otherwise(F.col("b")).alias("b"), F.when(day == 200, F.col("m") + 1).otherwise(F.col("m")).alias("m"))
    both = one.join(two, "d", "full")
    apart = F.abs(F.col("ret_eqw") - F.col("b")) >= 1e-9
    return both.agg(F.count("*").alias("days"), F.count_if(F.col("m").isNull() | F.col("n_stocks").isNull()).alias("only_one"), F.count_if(apart).alias("n_apart"), F.count_if(F.col("n_stocks") != F.col("m")).alias("n_mismatch"))


@query("r17_sensitivity_subset", panel_sql("""m AS (SELECT event_id, list(o_orderkey) AS ids FROM ev JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od FROM orders) o ON od = anchor GROUP BY event_id) SELECT event_id, len(ids) AS n_ann FROM m WHERE len(list_filter(ids, lambda k: k % 5 = 0)) = 0"""))
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events none of whose announcements (the day's orders) has an unresolved holder."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("anchor"))
    x = first_events(spark, sf_dir).join(o, "anchor").groupBy("event_id").agg(F.count("*").alias("n_ann"), F.bool_or(F.col("o_orderkey") % 5 == 0).alias("open"))
    return x.filter("not open").select("event_id", "n_ann")


@query("a42_direction_calibration", panel_sql("""h AS (SELECT sec, count(*) AS n, avg(ln(CAST(close AS DOUBLE)) - ln(CAST(open AS DOUBLE))) AS caar FROM bars GROUP BY sec),
s AS (SELECT *, CASE WHEN n < 800 THEN 'INSUFFICIENT' WHEN abs(caar) < 0.005 THEN 'NOT_SIG' ELSE 'SIG' END AS status, CASE WHEN ascii(right(sec, 1)) % 3 = 0 THEN 'down' WHEN ascii(right(sec, 1)) % 3 = 1 THEN 'up' END AS predicted FROM h), t AS (SELECT *, CASE WHEN predicted IS NULL OR status = 'INSUFFICIENT' THEN NULL ELSE (caar > 0) = (predicted = 'up') END AS hit FROM s),
g AS (SELECT status, count(*) AS studies, count(hit) AS judged, count(*) FILTER (hit) AS hits FROM t GROUP BY status)
SELECT status, studies, judged, hits, CASE WHEN judged > 0 THEN round((hits / judged + 1.9207294103470555 / judged - 1.959963984540054 * sqrt(hits / judged * (1 - hits / judged) / judged + 0.96036470517352775 / (judged * judged))) / (1 + 3.841458820694111 / judged), 9) END AS lo FROM g"""))
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sign of an effect is the one predicted, by status; studies without a prediction or with too few events aren't judged."""
    h = bars(spark, sf_dir).groupBy("sec").agg(F.count("*").alias("n"), F.avg(F.ln(F.col("close").cast("double")) - F.ln(F.col("open").cast("double"))).alias("caar"))
    last = F.ascii(F.right("sec", F.lit(1))) % 3
    status = F.when(F.col("n") < 800, "INSUFFICIENT").when(F.abs("caar") < 0.005, "NOT_SIG").otherwise("SIG")
    x = h.select("caar", status.alias("status"), F.when(last == 0, "down").when(last == 1, "up").alias("predicted"))
    hit = F.when(F.col("predicted").isNotNull() & (F.col("status") != "INSUFFICIENT"), (F.col("caar") > 0) == (F.col("predicted") == "up"))
    g = x.groupBy("status").agg(F.count("*").alias("studies"), F.count(hit).alias("judged"), F.count_if(hit).alias("hits"))
    n = F.nullif(F.col("judged"), F.lit(0)).cast("double")
    return g.select("status", "studies", "judged", "hits", F.round(S.wilson(F.col("hits").cast("double"), n)[0], 9).alias("lo"))
