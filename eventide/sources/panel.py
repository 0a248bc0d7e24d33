"""Price panels, calendars and events projected from order tables.

A security is a value of a column of part; its bar on a day comes from the lines shipped that day.
Prices are DECIMAL(18,4), so that thresholds are closed intervals; logs use doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPARSE, DENSE = "p_brand", "p_type"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price(ten_thousandths: Column) -> Column:
    return (ten_thousandths.cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)")


def bars(spark: SparkSession, sf_dir: str, key: str = SPARSE) -> DataFrame:
    """(sec, d, open, high, low, close, amount, vol): a row per security and day with a shipment."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("sec"))
    line = read(spark, sf_dir, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").cast("date").alias("d"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("q"),
    )
    # cents * 100 div units: whole-number division has no ties that engines round apart
    rows = line.join(part, line.l_partkey == part.p_partkey).withColumn("u", F.expr("(cents * 100) div q"))
    return rows.groupBy("sec", "d").agg(
        price(F.min(F.struct("seq", "u"))["u"]).alias("open"), price(F.max("u")).alias("high"), price(F.min("u")).alias("low"),
        price(F.expr("(sum(cents) * 100) div sum(q)")).alias("close"), (F.sum("cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), F.sum("q").alias("vol"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, cal_idx): the open days; a day count, so one task numbers them."""
    days = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return days.withColumn("cal_idx", F.row_number().over(Window.orderBy("d")) - 1)


def industry(sec: Column) -> Column:
    return F.concat(F.lit("I"), (F.length(sec) + F.ascii(F.substring(sec, -1, 1))) % 3)


def first_events(spark: SparkSession, sf_dir: str, key: str = SPARSE) -> DataFrame:
    """(event_id, sec, anchor, layer): the earliest order of each security in each quarter."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("sec"))
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("p_partkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("anchor"), "o_orderpriority")
    rows = orders.join(line, orders.o_orderkey == line.l_orderkey).join(part, "p_partkey")
    w = Window.partitionBy("sec", F.trunc("anchor", "quarter")).orderBy("anchor", "o_orderkey")
    first = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return first.select(
        F.concat_ws(":", "sec", F.date_format("anchor", "yyyyMMdd")).alias("event_id"), "sec", "anchor",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "good").when(F.col("o_orderpriority") == "3-MEDIUM", "turnaround").otherwise("bad").alias("layer"),
    )


#: The same projection for DuckDB; {key} is the column of part.
PANEL_SQL = """WITH line AS (
  SELECT p.{key} AS sec, CAST(l_shipdate AS DATE) AS d, l_orderkey * 100 + l_linenumber AS seq,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN part p ON l_partkey = p_partkey
), bars AS (
  SELECT sec, d, CAST(CAST(min(struct_pack(s := seq, u := cents * 100 // q)).u AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS open,
         CAST(CAST(max(cents * 100 // q) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS high,
         CAST(CAST(min(cents * 100 // q) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS low,
         CAST(CAST(CAST(sum(cents) AS BIGINT) * 100 // CAST(sum(q) AS BIGINT) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS close,
         CAST(CAST(sum(cents) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2)) AS amount, CAST(sum(q) AS BIGINT) AS vol
  FROM line GROUP BY sec, d
), cal AS (
  SELECT d, row_number() OVER (ORDER BY d) - 1 AS cal_idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
), ev AS (
  SELECT sec || ':' || strftime(anchor, '%Y%m%d') AS event_id, sec, anchor,
         CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN 'good' WHEN pr = '3-MEDIUM' THEN 'turnaround' ELSE 'bad' END AS layer
  FROM (
    SELECT p.{key} AS sec, CAST(o_orderdate AS DATE) AS anchor, o_orderpriority AS pr,
           row_number() OVER (PARTITION BY p.{key}, date_trunc('quarter', o_orderdate) ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn
    FROM orders JOIN (SELECT l_orderkey, min(struct_pack(n := l_linenumber, p := l_partkey)).p AS pk FROM lineitem GROUP BY l_orderkey) f ON o_orderkey = l_orderkey
    JOIN part p ON p.p_partkey = f.pk
  ) WHERE rn = 1
)"""


def panel_sql(rest: str, key: str = SPARSE) -> str:
    """The panel's CTEs with more CTEs or the final SELECT after them."""
    rest = rest.strip()
    return PANEL_SQL.replace("{key}", key) + ("\n" if rest.upper().startswith("SELECT") else ",\n") + rest
