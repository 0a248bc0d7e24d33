"""Every query with SQL against DuckDB on the small tables; every query's schema is stable."""

import datetime
import decimal
import math

import duckdb
import pytest

from eventide import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.load()  # before any session is there


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 7) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()[:19]
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    return tuple(map(plain, v))


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=order)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=order)
    registry.close_all()
    assert got == want
