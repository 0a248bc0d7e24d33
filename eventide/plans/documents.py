"""Queries over documents, stored order and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.operators import documents as D
from eventide.operators import lineage
from eventide.registry import keep, own, query
from eventide.sources.panel import bars, panel_sql, read
from eventide.sources.storage import Bucketed

EVENTS_SQL = "x AS (SELECT event_id, user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour FROM events)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, event_type, r): an event as a nested result."""
    cents = F.round(F.col("value") * 100).cast("long")
    digits = F.transform(F.split(cents.cast("string"), ""), lambda c: F.concat(F.lit("d"), c))
    at = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"))
    props = F.from_json("props", "k long")
    r = F.struct(F.col("event_type").alias("type"), cents.alias("cents"), digits.alias("digits"), at.alias("at"), props.alias("props"), F.col("event_id").alias("_id"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", r.alias("r"))


@query("u05_leaf_diff", f"""WITH {EVENTS_SQL}, l AS (
  SELECT event_id, '$.type' AS path, '"' || event_type || '"' AS v FROM x UNION ALL SELECT event_id, '$.cents', CAST(cents AS VARCHAR) FROM x UNION ALL SELECT event_id, '$.at.day', '"' || day || '"' FROM x
  UNION ALL SELECT event_id, '$.props.k', k FROM x UNION ALL SELECT event_id, '$.digits[' || (i - 1) || ']', '"d' || substr(CAST(cents AS VARCHAR), i, 1) || '"' FROM (SELECT *, unnest(range(1, length(CAST(cents AS VARCHAR)) + 1)) AS i FROM x)),
p AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM x),
a AS (SELECT p.event_id, path, v FROM p JOIN l ON l.event_id = p.prev), b AS (SELECT p.event_id, path, v FROM p JOIN l USING (event_id) WHERE prev IS NOT NULL)
SELECT event_id, path, a.v AS "left", b.v AS "right" FROM a FULL JOIN b USING (event_id, path) WHERE a.v IS DISTINCT FROM b.v""")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's results against the ones before, leaf by leaf; the hour and what names the run are left out."""
    rows = results(spark, sf_dir).withColumn("doc", F.to_json("r"))
    pairs = keep(rows.withColumn("before", F.lag("doc").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("before is not null").select("event_id", "before", "doc"))
    return D.leaf_diff(pairs.select("event_id", F.col("before").alias("doc")), pairs.select("event_id", "doc"), ["event_id"], "doc", ignore=("$._id", "$.at.hour"))


DIGEST_SQL = """d AS (SELECT event_type, sha256('{"at":{"day":"' || day || '","hour":' || hour || '},"cents":' || cents || ',"digits":[' || array_to_string(list_transform(string_split(CAST(cents AS VARCHAR), ''), lambda c: '"d' || c || '"'), ',')
  || '],"props":{"k":' || k || '},"type":"' || event_type || '"}' || chr(10)) AS d FROM x)"""


@query("l10_row_digests", f"WITH {EVENTS_SQL}, {DIGEST_SQL} SELECT event_type, count(*) AS n, count(*) AS agree, min(d) AS first_digest, max(d) AS last_digest FROM d GROUP BY 1")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every result, from its nested columns and from JSON text with names in another order."""
    rows = results(spark, sf_dir).withColumn("doc", F.to_json("r"))
    both = rows.select("event_type", D.canonical_digests(rows, "r").alias("d"), D.canonical_digests(rows, "doc").alias("e"))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("d") == F.col("e")).alias("agree"), F.min("d").alias("first_digest"), F.max("d").alias("last_digest"))


@query("k04_tree_digests", f"""WITH {EVENTS_SQL}, {DIGEST_SQL}, b AS (SELECT event_type, substr(d, 1, 2) AS b, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS s FROM d GROUP BY 1, 2)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(b || ':' || s, chr(10) ORDER BY b)) AS digest FROM b GROUP BY 1""")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each kind's results as a whole, made in two steps."""
    rows = results(spark, sf_dir)
    return D.tree_digests(rows.select("event_type", D.canonical_digests(rows, "r").alias("d")), ["event_type"], "d")


@query("s13_ordered_scan", panel_sql("SELECT sec, d, close, row_number() OVER w AS own_idx, lag(close) OVER w AS prev, CAST(sum(amount) OVER (PARTITION BY sec ORDER BY d ROWS 4 PRECEDING) AS DOUBLE) AS amount5 FROM bars WINDOW w AS (PARTITION BY sec ORDER BY d)"))
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored by security and day; the scan and its windows move no row."""
    return ordered_windows(stored_bars(spark, sf_dir).df)


def stored_bars(spark: SparkSession, sf_dir: str) -> Bucketed:
    table = Bucketed(bars(spark, sf_dir), ["sec"], ["d"])
    own(table.drop)
    return table


def ordered_windows(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("sec").orderBy("d")
    return rows.select("sec", "d", "close", F.row_number().over(w).alias("own_idx"), F.lag("close").over(w).alias("prev"), F.sum("amount").over(w.rowsBetween(-4, 0)).cast("double").alias("amount5"))


@query("l05_lineage_closure", """WITH RECURSIVE p AS (SELECT o_orderkey AS child, CAST(floor(o_totalprice) AS BIGINT) % (o_orderkey + 1) AS parent FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 3 > 0 AND CAST(floor(o_totalprice) AS BIGINT) % (o_orderkey + 1) > 0
  UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT child, parent AS ancestor FROM p UNION SELECT c.child, p.parent FROM c JOIN p ON p.child = c.ancestor),
m AS (SELECT o_orderkey AS batch FROM orders WHERE o_orderstatus <> 'F')
SELECT child AS batch, count(*) AS n_ancestors, count(*) FILTER (m.batch IS NULL) AS n_outside, min(ancestor) FILTER (m.batch IS NULL) AS first_outside, bool_or(child = ancestor) AS cyclic
FROM c LEFT JOIN m ON m.batch = ancestor GROUP BY child HAVING count(*) FILTER (m.batch IS NULL) > 0 OR bool_or(child = ancestor)""")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, whose price and customer say what they were made from; the manifest pins those that aren't finished."""
    o = read(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    made = o.select(F.col("o_orderkey").alias("child"), (price % (F.col("o_orderkey") + 1)).alias("parent"), price.alias("_p")).filter("_p % 3 > 0 and parent > 0").drop("_p")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"))
    pinned = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("batch"))
    return lineage.unpinned(o.select(F.col("o_orderkey").alias("batch")), made.union(urgent), pinned, keep)
