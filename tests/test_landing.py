"""Batches and the ledger under broken and concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.operators import ledger as L
from eventide.sources import readers
from eventide.sources.landing import Folder, Landing

PLAN = {k: "x" for k in L.REQUIRED} | {"pap_schema_version": 2, "analysis_type": "event"}


def together(*jobs):
    out, errors = [None] * len(jobs), []

    def run(i):
        try:
            out[i] = jobs[i]()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out, errors


def test_create_if_absent(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    out, errors = together(*(lambda i=i: folder.create("x", f"text {i}") for i in range(8)))
    assert sorted(out) == [False] * 7 + [True] and not errors
    assert folder.text("x") == f"text {out.index(True)}" and folder.names() == ["x"]


def test_batch_is_whole_or_absent(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table, df = Landing(spark, path), spark.range(5)
    assert table.land(df, 1, expect=5).rows == 5
    for wrong in ({"expect": 6}, {"schema": StructType.fromDDL("id int")}, {"unique": ["id"]}, {"shard": "id", "expect_shards": 4}):
        with pytest.raises(ValueError):
            table.land(df.union(df) if "unique" in wrong else df, 2, **wrong)
        assert spark.read.parquet(path).count() == 5 and table.ids() == [1] and not table.pending()
    with pytest.raises(ValueError):
        table.land(df.withColumn("x", F.lit(1)), 2)  # other columns than the table's
    with pytest.raises(Exception, match="broken"):
        table.land(df.select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")), 2)
    assert spark.read.parquet(path).count() == 5 and table.land(df, 2).batch_id == 2

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:  # after the rows are written, before they are published
        m.setattr(Folder, "rename", killed)
        with pytest.raises(Killed):
            table.land(df, 3)
    assert spark.read.parquet(path).filter("batch_id = 3").count() == 0 and table.ids() == [1, 2] and table.pending() == [3]
    with pytest.raises(ValueError):
        table.land(df, 3)  # another may still be at it
    table.recover(3)
    assert table.land(df, 3).rows == 5 and readers.current(spark.read.parquet(path)).count() == 5


def test_shards_are_distinct_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1)], "shard string, v int")
    got = Landing(spark, str(tmp_path / "t")).land(rows, 7, shard="shard", expect_shards=2, distinct=True, expect=4, note="pull of day 7")
    assert (got.rows, got.duplicates, got.shards) == (4, 2, 2)
    assert Landing(spark, str(tmp_path / "t")).record(7) == got


def test_two_writers_of_one_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    out, errors = together(*(lambda i=i: Landing(spark, path).land(spark.range(i + 1), 1).rows for i in range(4)))
    assert len(errors) == 3 and all(isinstance(e, ValueError) for e in errors)
    assert spark.read.parquet(path).count() == next(n for n in out if n)


def test_two_writers_of_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def writer(family):
        book = L.Ledger(spark, path)
        return [book.register(family=family if i % 2 else "shared", title=f"{family} {i}", source_type="human", verdict_power="full", plan=PLAN) for i in range(50)]

    out, errors = together(lambda: writer("f"), lambda: writer("g"))
    assert not errors and sorted(out[0] + out[1]) == list(range(1, 101))
    rows = L.Ledger(spark, path).state().collect()
    for family, n in (("f", 25), ("g", 25), ("shared", 50)):
        assert sorted(r.family_trial for r in rows if r.family == family) == list(range(1, n + 1))


def test_steps_that_exclude_each_other(spark, tmp_path):
    path = str(tmp_path / "ledger")
    book = L.Ledger(spark, path)
    one = book.register(family="f", title="t", source_type="human", verdict_power="full", plan=PLAN)
    book.step(one, "frozen")
    book.step(one, "running")
    _, errors = together(*(lambda i=i: L.Ledger(spark, path).finish(one, {"verdict": i}) for i in range(4)))
    assert len(errors) == 3 and all(isinstance(e, ValueError) for e in errors)
    assert L.Ledger(spark, path).log().filter("status = 'done'").count() == 1


def test_ingest_is_resumed(spark, tmp_path, monkeypatch):
    from eventide.sources.ingest import ingest

    folder, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "check")
    folder.mkdir()
    schema = StructType.fromDDL("code string, day int, v double")
    line = '{{"code": "{}", "day": {}, "v": {}}}\n'.format

    def run(files_each=None):
        return ingest(spark, str(folder), schema, ["code", "day"], table, check, files_each=files_each)

    (folder / "a.jsonl").write_text(line("x", 1, 1.5) + line("y", 1, 2))
    (folder / "b.jsonl").write_text(line("x", 2, 3))
    assert run(files_each=1) == [0, 1] and run() == []
    assert spark.read.parquet(table).count() == 3

    # a run that dies after a batch is landed and before its checkpoint lands nothing twice
    (folder / "c.jsonl").write_text(line("z", 1, 4))
    land = Landing.land
    with monkeypatch.context() as m:
        m.setattr(Landing, "land", lambda self, *a, **k: (land(self, *a, **k), 1 / 0))
        with pytest.raises(Exception, match="ZeroDivisionError"):
            run()
    assert run() == [] and Landing(spark, table).ids() == [0, 1, 2] and spark.read.parquet(table).count() == 4

    # a key of the first run comes again: nothing of the batch is landed until the file is mended
    bad = folder / "d.jsonl"
    bad.write_text(line("w", 1, 5) + line("x", 1, 9))
    with pytest.raises(Exception, match="a key that has come before"):
        run()
    assert spark.read.parquet(table).count() == 4 and not Landing(spark, table).pending()
    bad.write_text(line("w", 1, 5) + line("x", 3, 9))
    assert run() == [3]
    assert sorted((r.code, r.day) for r in spark.read.parquet(table).collect()) == [("w", 1), ("x", 1), ("x", 2), ("x", 3), ("y", 1), ("z", 1)]
    for text in ('{"code": "q", "day": "no"', line("q", 1, 1) + line("q", 1, 2), '{"day": 1}\n'):
        other = str(tmp_path / f"check{len(text)}")
        (tmp_path / f"in{len(text)}").mkdir()
        (tmp_path / f"in{len(text)}" / "x.jsonl").write_text(text)
        with pytest.raises(Exception):
            ingest(spark, str(tmp_path / f"in{len(text)}"), schema, ["code", "day"], str(tmp_path / f"t{len(text)}"), other)
        assert Landing(spark, str(tmp_path / f"t{len(text)}")).ids() == []
