"""Readers: batch-pinned views, the holdout guard, as-of segments, append-only batches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.sources.landing import Landing

#: Fixed value: days from here on are held out of every study.
HOLDOUT = "2024-07-01"


def assert_schema(df: DataFrame, schema: StructType) -> DataFrame:
    have, want = [(f.name, f.dataType) for f in df.schema.fields], [(f.name, f.dataType) for f in schema.fields]
    if have != want:
        raise ValueError(f"schema drift: have {have}, want {want}")
    return df


def before_holdout(df: DataFrame, *dates: str, null_passes: bool = False) -> DataFrame:
    """Only rows whose dates all lie before the holdout; NULL passes where a view says so."""
    for d in dates:
        ok = F.col(d) < F.lit(HOLDOUT).cast("date")
        df = df.filter(ok | F.col(d).isNull() if null_passes else ok)
    return df


def current(df: DataFrame, key: str = "batch_id") -> DataFrame:
    """Rows of the latest batch; the id is read once, so that it prunes partitions as a literal."""
    last = df.agg(F.max(key)).first()[0]
    return df.filter(F.col(key) == F.lit(last)) if last is not None else df.limit(0)


#: Codes by suffix: every exchange but Beijing's, or Shanghai's and Shenzhen's only.
SUFFIXES = {"not_bj": r"^(?!.*\.BJ$)", "sh_sz": r"\.(SH|SZ)$"}


def reader_view(
    table: DataFrame, columns: list[str], *, batch: int | None = None, dates: tuple[str, ...] = (), null_passes: bool = False, suffix: str | None = None, code: str = "ts_code", where: str | None = None
) -> DataFrame:
    """A snapshot table as a study may see it, with the batch that it comes from.

    One code path for the current view (the latest batch) and the pinned one (`batch`): dates before the holdout, codes by suffix, and a
    condition that all rows meet. batch_id is compared with a literal, so that it prunes partitions.
    """
    rows = current(table) if batch is None else table.filter(F.col("batch_id") == F.lit(batch))
    rows = before_holdout(rows, *dates, null_passes=null_passes)
    if suffix is not None:
        rows = rows.filter(F.col(code).rlike(SUFFIXES[suffix]))
    if where is not None:
        rows = rows.filter(where)
    return rows.select(*columns, F.concat(F.lit("batch"), F.col("batch_id")).alias("snapshot_batch"))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a header under a fixed schema; a header that differs from it, or a value that doesn't parse, raises."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """A checkpoint of JSON lines; a key that occurs twice raises."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    twice = rows.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0][key]!r} occurs {twice[0]['count']} times in the checkpoint")
    return rows


def first_disclosure(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def segments(changes: DataFrame, key: str = "sec", start: str = "start_date") -> DataFrame:
    """Closes each segment at the next one's start (NULL: open)."""
    return changes.withColumn("next_start", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def as_of_segment(rows: DataFrame, segs: DataFrame, d: str = "d", key: str = "sec", start: str = "start_date") -> DataFrame:
    """The segment in force on a day. One union and one window by key: no row pairs are made."""
    cols = [c for c in segs.columns if c not in (key, "next_start")]
    kind = segs.select(F.struct(*cols).alias("s")).schema["s"].dataType
    left = rows.withColumn("_seg", F.lit(None).cast(kind)).withColumn("_t", F.lit(1))
    right = segs.select(*(F.col(c) if c == key else (F.col(start).alias(c) if c == d else F.lit(None).cast(rows.schema[c].dataType).alias(c)) for c in rows.columns), F.struct(*cols).alias("_seg"), F.lit(0).alias("_t"))
    w = Window.partitionBy(key).orderBy(d, "_t").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).filter("_t = 1")
    return filled.select(*rows.columns, *(F.col(f"_seg.{c}").alias(c) for c in cols))


def last_day_upto(rows: DataFrame, calendar: DataFrame, d: str) -> DataFrame:
    """Adds the index of the last open day <= d (NULL before the axis)."""
    return _axis(rows, calendar, d, F.last, Window.unboundedPreceding, 0, 1)


def first_day_from(rows: DataFrame, calendar: DataFrame, d: str) -> DataFrame:
    """Adds the index of the first open day >= d (NULL behind the axis)."""
    return _axis(rows, calendar, d, F.first, 0, Window.unboundedFollowing, -1)


def _axis(rows: DataFrame, calendar: DataFrame, d: str, pick, lo, hi, side: int) -> DataFrame:
    # the distinct days are a bounded axis, so one window over them is small; rows then join by day
    days = rows.select(F.col(d).alias("d")).distinct().withColumn("cal_idx", F.lit(None).cast("int")).withColumn("_t", F.lit(side))
    axis = calendar.select("d", "cal_idx").withColumn("_t", F.lit(0)).unionByName(days)
    w = Window.orderBy("d", "_t").rowsBetween(lo, hi)
    found = axis.withColumn("cal_idx", pick("cal_idx", ignorenulls=True).over(w)).filter(F.col("_t") == side).select(F.col("d").alias(d), "cal_idx")
    return rows.join(found, d, "left")


def append_batch(df: DataFrame, path: str, batch_id: int, *, expect: int | None = None) -> int:
    """Appends one batch, whole or not at all; fails if it exists, or if what was staged has other columns than the table or not `expect` rows."""
    return Landing(df.sparkSession, path).land(df, batch_id, expect=expect).rows


def land_derived(rows: DataFrame, other: DataFrame, path: str, batch_id: int, *, keys: list[str], value: str, tolerance: float = 1e-9) -> int:
    """Appends a derived table only if a second computation has the same keys, and values within `tolerance`."""
    a, b = rows.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_left")), other.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_right"))
    both = a.join(b, keys, "full")
    one = both.agg(F.count_if(F.col("_left").isNull() | F.col("_right").isNull()).alias("keys"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("nulls"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("apart")).first()
    if one["keys"] or one["nulls"] or (one["apart"] or 0.0) > tolerance:
        raise ValueError(f"the two computations differ: {one.asDict()}")
    return append_batch(rows, path, batch_id, expect=rows.count())


def evidence_manifest(files: DataFrame, *, pull_time: str) -> dict:
    """The digest of each evidence file (binaryFile rows), and of the sorted list."""
    rows = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name").collect()  # a list of files
    listed = [r.asDict() for r in rows]
    return {"pull_time": pull_time, "files": listed, "digest": hashlib.sha256("".join(f"{r['name']}:{r['sha256']}\n" for r in listed).encode()).hexdigest()}


def canonical_digest(value: dict) -> str:
    """sha256 of the sorted, compact JSON and a line end, without the document's own keys that begin with an underscore."""
    own = {k: v for k, v in value.items() if not k.startswith("_")}
    return hashlib.sha256((json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()).hexdigest()


class SnapshotReader:
    """Reads tables at the batches that a published manifest pins; anything unpinned raises."""

    def __init__(self, spark: SparkSession, manifest: dict[str, int], paths: dict[str, str], digest: str):
        if canonical_digest(manifest) != digest:
            raise ValueError("the manifest doesn't match its published digest")
        self.spark, self.manifest, self.paths = spark, manifest, paths

    def table(self, name: str) -> DataFrame:
        if name not in self.manifest or name not in self.paths:
            raise KeyError(f"{name} is not pinned by the snapshot")
        return self.spark.read.parquet(self.paths[name]).filter(F.col("batch_id") == F.lit(self.manifest[name]))
