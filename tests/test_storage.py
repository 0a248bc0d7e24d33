"""Stored order without shuffles, and lineage over several levels."""

import pytest
from pyspark.sql import functions as F

from eventide import registry
from eventide.operators import lineage
from eventide.plans.documents import ordered_windows
from eventide.sources.storage import Bucketed, exchanges


def test_stored_order_needs_no_exchange(spark):
    rows = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 37).alias("sec"), (F.col("id") * 7919 % 2003).alias("d"), F.col("id").alias("close"), (F.col("id") % 11).alias("amount"))
    a, b = Bucketed(rows, ["sec"], ["d"], buckets=4), Bucketed(rows.select("sec", "d", (F.col("close") + 1).alias("open")), ["sec"], ["d"], buckets=8)
    try:
        assert exchanges(ordered_windows(rows))  # what it costs otherwise
        assert exchanges(a.df.select("sec", "d")) == [] and exchanges(ordered_windows(a.df)) == []
        assert exchanges(a.df.groupBy("sec").agg(F.sum("close"))) == []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        same = Bucketed(rows.groupBy("sec").agg(F.max("d").alias("last")), ["sec"], buckets=4)
        assert exchanges(a.df.join(same.df, "sec")) == []
        # half as many buckets on one side: that side alone is dealt again
        assert len(exchanges(a.df.join(b.df, ["sec"]))) <= 1
        key = ["sec", "d"]
        assert sorted(map(tuple, ordered_windows(a.df).orderBy(*key).collect())) == sorted(map(tuple, ordered_windows(rows).orderBy(*key).collect()))
        assert a.df.inputFiles() and len(a.df.inputFiles()) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in (a, b, same):
            t.drop()
    assert not spark.catalog.tableExists(a.name)


def test_lineage_closure(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", None), ("a", "b"), ("s", "s")]
    parents = spark.createDataFrame(pairs, "child string, parent string")
    got = {(r.child, r.ancestor): r.level for r in lineage.closure(parents, registry.keep).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    assert got["x", "x"] == 3 and got["s", "s"] == 1 and ("q", None) not in got
    batches = spark.createDataFrame([(c,) for c in "abcdefxyzqs"], "batch string")
    pinned = spark.createDataFrame([(c,) for c in "bcdexyzs"], "batch string")
    out = {r.batch: (r.n_ancestors, r.n_outside, r.first_outside, r.cyclic) for r in lineage.unpinned(batches, parents, pinned, registry.keep).collect()}
    assert out == {**{c: (n, 1, "f", False) for c, n in zip("abcde", (5, 4, 3, 2, 1))}, **{c: (3, 0, None, True) for c in "xyz"}, "s": (1, 0, None, True)}
    with pytest.raises(ValueError):
        lineage.closure(parents, registry.keep, most_levels=2)
    registry.close_all()


def test_lineage_of_many_batches_from_few_writes_few_pairs(spark):
    pairs = [(i, i - 1) for i in range(1, 12)] + [(100 + i, 11) for i in range(2000)]
    parents = spark.createDataFrame(pairs, "child long, parent long")
    written = []

    def keep(df):
        written.append(registry.keep(df))
        return written[-1]

    batches, pinned = spark.range(2200).select(F.col("id").alias("batch")), spark.range(1, 2200).select(F.col("id").alias("batch"))
    out = {r.batch: (r.n_ancestors, r.n_outside, r.first_outside, r.cyclic) for r in lineage.unpinned(batches, parents, pinned, keep).collect()}
    assert out == {**{i: (i, 1, 0, False) for i in range(1, 12)}, **{100 + i: (12, 1, 0, False) for i in range(2000)}}
    assert sum(w.count() for w in written) < 2 * len(pairs)  # all 24,066 ways were written before, and in each round again
    registry.close_all()
