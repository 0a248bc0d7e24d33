"""Queries over readers, joins, set operations and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import returns as R
from eventide.registry import query
from eventide.sources import readers
from eventide.sources.panel import bars, calendar, first_events, industry, panel_sql, read

CODE_SQL = """CASE CAST(replace(sec, 'Brand#', '') AS INTEGER) % 5 WHEN 0 THEN '600' WHEN 1 THEN '688' WHEN 2 THEN '300' WHEN 3 THEN '000' ELSE '830' END
 || lpad(replace(sec, 'Brand#', ''), 3, '0') || CASE CAST(replace(sec, 'Brand#', '') AS INTEGER) % 5 WHEN 0 THEN '.SH' WHEN 1 THEN '.SH' WHEN 4 THEN '.BJ' ELSE '.SZ' END"""


def code_of(sec):
    n = F.replace(sec, F.lit("Brand#"), F.lit(""))
    k = n.cast("int") % 5
    head = F.when(k == 0, "600").when(k == 1, "688").when(k == 2, "300").when(k == 3, "000").otherwise("830")
    return F.concat(head, F.lpad(n, 3, "0"), F.when(k <= 1, ".SH").when(k == 4, ".BJ").otherwise(".SZ"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name changes: every quarter's first event renames its security."""
    alias = F.when(F.col("layer") == "good", F.concat(F.lit("N"), "sec")).when(F.col("layer") == "bad", F.concat(F.lit("*ST "), "sec")).otherwise(F.concat("sec", F.lit("退")))
    return first_events(spark, sf_dir).select("sec", F.col("anchor").alias("start_date"), alias.alias("alias"))


NAMES_SQL = """seg AS (SELECT sec, anchor AS start_date, CASE layer WHEN 'good' THEN 'N' || sec WHEN 'bad' THEN '*ST ' || sec ELSE sec || '退' END AS alias,
  lead(anchor) OVER (PARTITION BY sec ORDER BY anchor) AS next_start FROM ev)"""
STATE_SQL = "CASE WHEN alias IS NULL THEN 'unknown' WHEN alias LIKE '%退' THEN 'delist' WHEN upper(alias) LIKE '%ST%' THEN 'st' ELSE 'normal' END"


@query("s01_calendar", "SELECT d, row_number() OVER (ORDER BY d) - 1 AS cal_idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) WHERE d < DATE '2024-07-01'")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.before_holdout(calendar(spark, sf_dir), "d")


@query("s02_price_view", panel_sql(NAMES_SQL + f""", b AS (SELECT *, lag(close) OVER (PARTITION BY sec ORDER BY d) AS pre_close FROM bars),
v AS (SELECT b.*, {CODE_SQL.replace('sec', 'b.sec')} AS code, {STATE_SQL} = 'st' AS is_st
  FROM b LEFT JOIN seg ON b.sec = seg.sec AND b.d >= seg.start_date AND (b.d < seg.next_start OR seg.next_start IS NULL)),
w AS (SELECT *, CASE WHEN code LIKE '%.BJ' THEN 'bse' WHEN code LIKE '688%' THEN 'star' WHEN code LIKE '300%' THEN 'chinext' ELSE 'main' END AS board FROM v),
x AS (SELECT *, CAST(CASE WHEN is_st THEN 0.05 WHEN board = 'main' THEN 0.10 WHEN board = 'chinext' AND d < DATE '2020-08-24' THEN 0.10 WHEN board IN ('chinext', 'star') THEN 0.20 ELSE 0.30 END AS DECIMAL(4,2)) AS limit_pct FROM w),
y AS (SELECT *, round(pre_close * (CAST(1 AS DECIMAL(4,2)) + limit_pct), 2) AS up, round(pre_close * (CAST(1 AS DECIMAL(4,2)) - limit_pct), 2) AS down FROM x)
SELECT code, d, close, open, board, is_st, limit_pct,
  CASE WHEN pre_close IS NULL OR pre_close = 0 THEN 'none' WHEN open = high AND high = low AND low = close AND (close = up OR close = down) THEN 'one_word' WHEN close = up THEN 'limit_up' WHEN close = down THEN 'limit_down' ELSE 'none' END AS limit_status,
  CASE WHEN pre_close IS NULL OR pre_close = 0 THEN 'none' WHEN open = down THEN 'limit_down' WHEN open = up THEN 'limit_up' ELSE 'none' END AS open_limit_status
FROM y WHERE code NOT LIKE '%.BJ'"""))
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("pre_close", F.lag("close").over(R.by_sec()))
    v = readers.as_of_segment(b, names(spark, sf_dir)).withColumn("code", code_of(F.col("sec"))).filter(~F.col("code").rlike(r"\.BJ$"))
    v = v.withColumn("is_st", S.name_state(F.col("alias")) == "st").withColumn("board", S.board(F.col("code")))
    v = v.withColumn("limit_pct", S.limit_pct(F.col("board"), F.col("is_st"), F.col("d")))
    c = F.col
    return v.select(
        "code", "d", "close", "open", "board", "is_st", "limit_pct",
        S.limit_status(c("open"), c("high"), c("low"), c("close"), c("pre_close"), c("limit_pct")).alias("limit_status"),
        S.open_limit_status(c("open"), c("pre_close"), c("limit_pct")).alias("open_limit_status"),
    )


@query("s04_first_disclosure", """SELECT user_id, day, event_id, layer FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id,
  CASE event_type WHEN 'purchase' THEN 'good' WHEN 'signup' THEN 'good' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'turnaround' END AS layer,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1 AND layer IS NOT NULL""")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = readers.first_disclosure(e, ["user_id", "day"], [F.asc_nulls_last("ts"), F.col("event_id")])
    t = F.col("event_type")
    layer = F.when(t.isin("purchase", "signup"), "good").when(t == "error", "bad").when(t == "view", "turnaround")
    return first.select("user_id", "day", "event_id", layer.alias("layer")).filter("layer is not null")


@query("s05_beijing_date", "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS event_date FROM events")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", S.beijing_date(F.col("ts")).alias("event_date"))


@query("s14_sample_pushdown", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(wanted, "l_orderkey", "left_semi")


@query("p_scalar_predicates", f"""WITH s AS (SELECT DISTINCT p_brand AS sec FROM part), c AS (SELECT {CODE_SQL} AS code FROM s), n AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', '') THEN 'unknown' ELSE c_mktsegment END AS industry,
  CASE WHEN c_acctbal > 0 AND c_nationkey > 5 THEN (c_acctbal + c_nationkey) / 2 WHEN c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 5 THEN c_nationkey END AS mid,
  CASE WHEN c_nationkey - 5 < 0 THEN 'negative' WHEN c_nationkey = 5 THEN 'same_day' WHEN c_nationkey <= 8 THEN '1-3' WHEN c_nationkey <= 15 THEN '4-10' ELSE 'over_10' END AS gap FROM n""")
def p_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", " NaN ").otherwise(F.col("c_mktsegment"))
    nation = F.col("c_nationkey").cast("double")
    return c.select(
        "c_custkey", S.norm_industry(seg).alias("industry"), S.midpoint(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(nation > 5, nation)).alias("mid"),
        S.gap_bucket(F.col("c_nationkey") - 5).alias("gap"),
    )


@query("p02_boards", f"SELECT code, CASE WHEN code LIKE '%.BJ' THEN 'bse' WHEN code LIKE '688%' THEN 'star' WHEN code LIKE '300%' THEN 'chinext' ELSE 'main' END AS board, right(code, 2) AS suffix FROM (SELECT {CODE_SQL} AS code FROM (SELECT DISTINCT p_brand AS sec FROM part))")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = read(spark, sf_dir, "part").select(F.col("p_brand").alias("sec")).distinct().select(code_of(F.col("sec")).alias("code"))
    return code.select("code", S.board(F.col("code")).alias("board"), S.suffix_bucket(F.col("code")).alias("suffix"))


@query("p25_parsing", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DECIMAL(38,10)) AS k, CAST(strftime(ts, '%H') AS INTEGER) * 60 + CAST(strftime(ts, '%M') AS INTEGER) AS minute FROM events""")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", S.parse_number(F.get_json_object("props", "$.k")).alias("k"), S.minutes(F.date_format("ts", "HH:mm")).alias("minute"))


@query("p29_ledger_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND (contains(source, 'src1') OR contains(CAST(doc_id AS VARCHAR), '7') OR contains(lower(text), 'password'))")
def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    q = F.col("source").contains("src1") | F.col("doc_id").cast("string").contains("7") | F.lower("text").contains("password")
    return d.filter((F.col("lang") == "en") & q).select("doc_id", "source")


@query("j03_name_segments", panel_sql(NAMES_SQL + f""" SELECT b.sec, b.d, alias, {STATE_SQL} AS state
FROM bars b LEFT JOIN seg ON b.sec = seg.sec AND b.d >= seg.start_date AND (b.d < seg.next_start OR seg.next_start IS NULL)"""))
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = readers.as_of_segment(bars(spark, sf_dir).select("sec", "d"), names(spark, sf_dir))
    return v.select("sec", "d", "alias", S.name_state(F.col("alias")).alias("state"))


@query("w04_segment_close", panel_sql(NAMES_SQL + " SELECT sec, start_date, next_start, alias FROM seg"))
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.segments(names(spark, sf_dir))


@query("w18_state_transitions", panel_sql(NAMES_SQL + f""", t AS (SELECT sec, start_date, {STATE_SQL} AS state, lag({STATE_SQL}) OVER (PARTITION BY sec ORDER BY start_date) AS prev FROM seg)
SELECT sec, start_date, prev || '>' || state AS transition FROM t WHERE prev IS NOT NULL AND prev <> state"""))
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir).withColumn("state", S.name_state(F.col("alias")))
    n = n.withColumn("prev", F.lag("state").over(Window.partitionBy("sec").orderBy("start_date")))
    return n.filter("prev <> state").select("sec", "start_date", F.concat_ws(">", "prev", "state").alias("transition"))


@query("j05_validity_interval", """WITH m AS (SELECT c_nationkey AS idx, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS in_date, max(CAST(o_orderdate AS DATE)) AS out_date
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT d, count(*) AS members, min(idx) AS first_member FROM t JOIN m ON d >= in_date AND d < out_date GROUP BY d""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("od"))
    m = orders.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("idx")), "o_custkey")
    m = m.groupBy("idx", F.year("od").alias("y")).agg(F.min("od").alias("in_date"), F.max("od").alias("out_date"))
    # days meet the intervals of their own year only: an equality that the shuffle can use
    t = calendar(spark, sf_dir).select("d", F.year("d").alias("y"))
    hit = t.join(m, "y").filter((F.col("d") >= F.col("in_date")) & (F.col("d") < F.col("out_date")))
    return hit.groupBy("d").agg(F.count("*").alias("members"), F.min("idx").alias("first_member"))


@query("j06_as_of_forward", panel_sql("SELECT event_id, (SELECT min(cal_idx) FROM cal WHERE d >= anchor + INTERVAL 1 DAY) AS idx FROM ev"))
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = first_events(spark, sf_dir).withColumn("t", F.date_add("anchor", 1))
    return readers.first_day_from(e, calendar(spark, sf_dir), "t").select("event_id", F.col("cal_idx").alias("idx"))


@query("j07_as_of_backward", panel_sql("SELECT event_id, (SELECT max(cal_idx) FROM cal WHERE d <= anchor) AS idx FROM ev"))
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.last_day_upto(first_events(spark, sf_dir), calendar(spark, sf_dir), "anchor").select("event_id", F.col("cal_idx").alias("idx"))


@query("j08_strict_prior_agreement", """WITH f AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'view'), x AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
l AS (SELECT event_id, x.user_id, max(f.day) AS day FROM x JOIN f ON x.user_id = f.user_id AND f.day < x.day GROUP BY 1, 2)
SELECT event_id, l.day AS prior_day, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS bound FROM l JOIN f ON l.user_id = f.user_id AND l.day = f.day GROUP BY 1, 2""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    f = e.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.count_distinct("value").alias("k"), F.min("value").alias("v"))
    f = f.select("user_id", "day", F.struct("day", F.when(F.col("k") == 1, F.col("v")).alias("bound")).alias("last"))
    x = e.filter("event_type = 'purchase'").select("user_id", "day", "event_id")
    w = Window.partitionBy("user_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    both = x.withColumn("last", F.lit(None).cast(f.schema["last"].dataType)).unionByName(f.withColumn("event_id", F.lit(None).cast("long")))
    both = both.withColumn("day", F.unix_date("day")).withColumn("prior", F.last("last", ignorenulls=True).over(w))
    return both.filter("event_id is not null and prior is not null").select("event_id", F.col("prior.day").alias("prior_day"), F.col("prior.bound").alias("bound"))


@query("j10_prior_year", panel_sql("""y AS (SELECT sec, year(d) AS y, sum(amount) AS amount FROM bars GROUP BY 1, 2)
SELECT a.sec, a.y, CASE WHEN b.amount IS NULL THEN 'no_prior' WHEN b.amount = 0 THEN 'undefined' WHEN CAST(a.amount AS DOUBLE) / CAST(b.amount AS DOUBLE) >= 1.1 THEN 'up' WHEN CAST(a.amount AS DOUBLE) / CAST(b.amount AS DOUBLE) <= 0.9 THEN 'down' ELSE 'inside' END AS class
FROM y a LEFT JOIN y b ON a.sec = b.sec AND b.y = a.y - 1"""))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = bars(spark, sf_dir).groupBy("sec", F.year("d").alias("y")).agg(F.sum("amount").alias("amount"))
    prior = y.select("sec", (F.col("y") + 1).alias("y"), F.col("amount").alias("prior"))
    ratio = F.try_divide(F.col("amount").cast("double"), F.col("prior").cast("double"))
    c = F.when(F.col("prior").isNull(), "no_prior").when(F.col("prior") == 0, "undefined").when(ratio >= 1.1, "up").when(ratio <= 0.9, "down").otherwise("inside")
    return y.join(prior, ["sec", "y"], "left").select("sec", "y", c.alias("class"))


@query("j13_exists", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 45)")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(hit, "s_suppkey", "left_semi")


@query("j17_manifest_values", "SELECT r_name, k AS key FROM region CROSS JOIN (VALUES ('bars'), ('calendar'), ('events')) v(k)")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a manifest row times a literal list: an explode, not a join
    return read(spark, sf_dir, "region").select("r_name", F.explode(F.array(*map(F.lit, ("bars", "calendar", "events")))).alias("key"))


@query("j21_source_cross_check", panel_sql(f"""r AS (SELECT d, avg(CAST(close AS DOUBLE)) AS c FROM bars GROUP BY d HAVING count(*) >= 10), q AS (SELECT d, avg(CAST(open AS DOUBLE)) AS c FROM bars GROUP BY d HAVING count(*) <= 16)
SELECT count(*) FILTER (q.d IS NULL) AS only_left, count(*) FILTER (r.d IS NULL) AS only_right, round(max(abs(r.c - q.c)), 6) AS max_abs_diff FROM r FULL OUTER JOIN q ON r.d = q.d"""))
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = bars(spark, sf_dir).groupBy("d").agg(F.avg(F.col("close").cast("double")).alias("l"), F.avg(F.col("open").cast("double")).alias("r"), F.count("*").alias("n"))
    both = day.filter("n >= 10").select("d", "l").join(day.filter("n <= 16").select("d", "r"), "d", "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.round(F.max(F.abs(F.col("l") - F.col("r"))), 6).alias("max_abs_diff"))


@query("a02_batch_vector", "SELECT o_orderpriority AS source, max(o_orderkey) AS batch_id, count(*) AS n FROM orders GROUP BY 1")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.max("o_orderkey").alias("batch_id"), F.count("*").alias("n"))


@query("a30_profile", """SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS big, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, CAST(ts AS DATE))) AS user_days,
  min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean, median(value) AS med, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS pos_frac, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1 HAVING count(*) > 10""")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    big = F.col("value") > 50
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(big).alias("big"), F.count_distinct("user_id").alias("users"), F.count_distinct("user_id", "day").alias("user_days"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("med"),
        F.round(F.avg(big.cast("double")), 6).alias("pos_frac"), F.round(F.stddev_samp("value"), 6).alias("sd"),
    ).filter("n > 10")


@query("a32_fold_conflicts", """SELECT user_id, day, CASE WHEN n = 1 THEN 'single' WHEN kinds = 1 THEN 'agree' ELSE 'conflict' END AS class FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2)""")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("k"))
    return g.select("user_id", "day", F.when(F.col("n") == 1, "single").when(F.col("k") == 1, "agree").otherwise("conflict").alias("class"))


@query("a33_strict_initial", """SELECT user_id, day, CASE WHEN n0 = 0 THEN 'no_initial' WHEN n0 > 1 THEN 'multiple_initial' WHEN v IS NULL THEN 'missing_value' WHEN v <= 5 THEN 'too_small' ELSE 'ok' END AS status
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS n0, max(value) FILTER (event_type = 'signup') AS v FROM events GROUP BY 1, 2)""")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("event_type") == "signup"
    g = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(first).alias("n0"), F.max(F.when(first, F.col("value"))).alias("v"))
    s = F.when(F.col("n0") == 0, "no_initial").when(F.col("n0") > 1, "multiple_initial").when(F.col("v").isNull(), "missing_value").when(F.col("v") <= 5, "too_small").otherwise("ok")
    return g.select("user_id", "day", s.alias("status"))


@query("a34_drop_duplicate_keys", "SELECT event_id, user_id FROM events WHERE (user_id, CAST(ts AS DATE), event_type) IN (SELECT (user_id, CAST(ts AS DATE), event_type) FROM events GROUP BY user_id, CAST(ts AS DATE), event_type HAVING count(*) = 1)")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key with one row keeps it: an aggregate, so that a common key costs no window
    g = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.first("event_id").alias("event_id"))
    return g.filter("n = 1").select("event_id", "user_id")


@query("a38_event_list_digest", panel_sql("""p AS (SELECT layer, year(anchor) AS y, sha256(string_agg(event_id || chr(10), '' ORDER BY event_id)) AS sha, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT layer, sha256(string_agg(CAST(y AS VARCHAR) || ':' || sha || chr(10), '' ORDER BY y)) AS sha, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY layer"""))
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a layer's events: of each year's sorted list, then of the years' digests, so that no task holds a whole layer."""
    lines = lambda *c: F.concat_ws("", F.sort_array(F.collect_list(F.concat(*c, F.lit("\n")))))
    years = first_events(spark, sf_dir).groupBy("layer", F.year("anchor").cast("string").alias("y")).agg(F.sha2(lines("event_id"), 256).alias("sha"), F.count("*").alias("n"))
    return years.groupBy("layer").agg(F.sha2(lines("y", F.lit(":"), "sha"), 256).alias("sha"), F.sum("n").alias("n"))


@query("a43_ordered_strings", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("a24_industry_unknown", "SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'MACHINERY') AS unknown, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) > 0.05 AS escalate FROM customer")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.norm_industry(F.when(F.col("c_mktsegment") == "MACHINERY", "none").otherwise(F.col("c_mktsegment")))
    c = read(spark, sf_dir, "customer").select((i == "unknown").alias("u"))
    return c.agg(F.count("*").alias("n"), F.count_if("u").alias("unknown"), (F.avg(F.col("u").cast("double")) > 0.05).alias("escalate"))


@query("u01_whole_row_dedup", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).dropDuplicates()


@query("u02_except_both_ways", """WITH a AS (SELECT user_id, event_type FROM events WHERE value < 40), b AS (SELECT user_id, event_type FROM events WHERE value > 20)
SELECT 'left' AS side, user_id, event_type FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', user_id, event_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one aggregate tells both differences
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") < 40).alias("a"), F.bool_or(F.col("value") > 20).alias("b"))
    return e.filter("a <> b").select(F.when(F.col("a"), "left").otherwise("right").alias("side"), "user_id", "event_type")


@query("u06_membership_minus", panel_sql("SELECT count(*) FILTER (b.sec IS NULL) AS missing, count(*) AS n FROM ev LEFT JOIN bars b ON b.sec = ev.sec AND b.d = anchor"))
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = bars(spark, sf_dir).select("sec", F.col("d").alias("anchor"), F.lit(1).alias("there"))
    return first_events(spark, sf_dir).join(there, ["sec", "anchor"], "left").agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count("*").alias("n"))


@query("t04_stratified_sample", panel_sql("""k AS (SELECT event_id, layer, row_number() OVER (PARTITION BY layer ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY layer) AS n FROM ev),
p AS (SELECT DISTINCT layer, CAST(round_even(j * (n - 1) / 4.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT layer, n FROM k) CROSS JOIN (SELECT unnest(range(5)) AS j))
SELECT k.layer, k.event_id FROM k JOIN p ON k.layer = p.layer AND k.i = p.i"""))
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("layer")
    k = first_events(spark, sf_dir).withColumns({"i": F.row_number().over(by.orderBy("event_id")) - 1, "n": F.count("*").over(by)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.bround(j * (F.col("n") - 1) / 4.0, 0).cast("int"))
    return k.filter(F.array_contains(wanted, F.col("i"))).select("layer", "event_id")


@query("t03_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)


@query("w20_strong_key_first", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).filter("user_id is not null and event_type is not null and ts is not null")
    return readers.first_disclosure(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")]).select("event_id")


@query("w21_pair_gaps", "SELECT event_id, day - lag(day) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)")
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.select("event_id", F.datediff("day", F.lag("day").over(w)).cast("long").alias("gap"))


@query("w24_family_trial", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS family_trial FROM orders")
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("family_trial"))


STATUS = {"signup": "registered", "view": "frozen", "click": "running", "purchase": "done", "error": "closed"}
ALLOWED = ["registered>frozen", "registered>closed", "frozen>running", "frozen>closed", "running>done"]


@query("l07_transition_rule", f"""WITH t AS (SELECT event_id, user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status, ts FROM events),
x AS (SELECT event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM t)
SELECT coalesce(prev, 'birth') || '>' || status AS step, count(*) AS n, bool_and(CASE WHEN prev IS NULL THEN status = 'registered' ELSE prev || '>' || status IN ({', '.join(f"'{a}'" for a in ALLOWED)}) END) AS allowed FROM x GROUP BY 1""")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("event_type"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = read(spark, sf_dir, "events").select(status.alias("status"), F.lag(status).over(w).alias("prev"))
    step = F.concat_ws(">", F.coalesce("prev", F.lit("birth")), "status")
    return x.groupBy(step.alias("step")).agg(F.count("*").alias("n")).withColumn("allowed", F.col("step").isin("birth>registered", *ALLOWED))


@query("l12_ledger_summary", "SELECT event_type AS status, count(*) AS n, count(*) FILTER (value > 50) AS hits FROM events GROUP BY 1")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"))
