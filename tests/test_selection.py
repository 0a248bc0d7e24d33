"""Selection queries on tables made for one case."""

import datetime

import duckdb

import __spark_entry__ as entry
from eventide import registry


def test_funnel_without_any_chain_is_conserved(spark, tmp_path):
    days = [datetime.datetime(1996, 1, 1) + datetime.timedelta(days=i) for i in range(20)]
    line = spark.createDataFrame([(i, 1, 1, 10.0, 1000.0, d) for i, d in enumerate(days)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    orders = spark.createDataFrame([(i, d, "3-MEDIUM") for i, d in enumerate(days)], "o_orderkey long, o_orderdate timestamp, o_orderpriority string")
    part = spark.createDataFrame([(1, "Brand#11", "PROMO")], "p_partkey long, p_brand string, p_type string")
    con = duckdb.connect()
    for name, df in {"lineitem": line, "orders": orders, "part": part}.items():
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us", index=False)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    cur = con.execute(entry.oracle_sql()["a36_funnel_conservation"])
    want = dict(zip([c[0] for c in cur.description], cur.fetchone()))
    got = entry.queries()["a36_funnel_conservation"](spark, str(tmp_path)).first().asDict()
    registry.close_all()
    assert got == want == {"chains": 0, "events": 0, "rejects": 0, "conserved": True}
