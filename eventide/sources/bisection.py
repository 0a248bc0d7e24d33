"""Date ranges halved until each fits on a page, with every row read twice (S23, without the network).

A source that answers at most a page at a time is read by ranges: an interval with more rows than a page is cut in half, and so on down to
single days, which are read page by page. Which ranges come about depends on the rows of each day only, so they are counted once and all
levels are made in one plan, whose rows are (key, day, level) and not the source's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.gates import behind, require


def halves(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Last day of the first half and first day of the second."""
    middle = F.date_add(lo, F.floor(F.date_diff(hi, lo) / 2).cast("int"))
    return middle, F.date_add(middle, 1)


def around(day: Column, lo: Column, hi: Column) -> Column:
    """The ranges (lo, hi) that hold a day, from the whole interval down to the day."""

    def next_half(met: Column, _: Column) -> Column:
        at = F.element_at(met, -1)
        left, right = halves(at["lo"], at["hi"])
        first = day <= left
        half = F.struct(F.when(first, at["lo"]).otherwise(right).alias("lo"), F.when(first, left).otherwise(at["hi"]).alias("hi"))
        return F.when(at["lo"] < at["hi"], F.concat(met, F.array(half))).otherwise(met)

    # an interval of n days has a level for each bit of n - 1
    levels = F.length(F.bin(F.date_diff(hi, lo)))
    return F.aggregate(F.sequence(F.lit(1), levels), F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), next_half)


def ranges(days: DataFrame, intervals: DataFrame, keys: list[str], *, page: int) -> DataFrame:
    """(keys, lo, hi, n, pages): the ranges that are read in the end, empty ones too, which cover each interval without gap or overlap.

    days: (keys, day, n); intervals: (keys, start, end), a row a key. Only single days have more than one page. Every range that was cut took one read, and a key with m
    ranges was cut m - 1 times, so with both passes its reads are sum(2 * pages) + m - 1.
    """
    met = days.join(intervals, keys).select(*keys, "n", F.explode(around(F.col("day"), F.col("start"), F.col("end"))).alias("r"))
    counts = met.groupBy(*keys, "r.lo", "r.hi").agg(F.sum("n").alias("n"))
    lo, hi, n = F.col("lo"), F.col("hi"), F.coalesce("n", F.lit(0))
    left, right = halves(lo, hi)
    both = F.array(F.struct("lo", left.alias("hi")), F.struct(right.alias("lo"), "hi"))
    is_cut = (n > page) & (lo < hi)
    # the rows of a whole are those of its halves, so what is cut always comes from something that was cut
    halved = counts.filter(is_cut).select(*keys, F.inline(both).alias("lo", "hi"))
    whole = intervals.select(*keys, F.col("start").alias("lo"), F.col("end").alias("hi"))
    read = whole.unionByName(halved).join(counts, [*keys, "lo", "hi"], "left").filter(~is_cut)
    return read.select(*keys, "lo", "hi", n.alias("n"), F.greatest(F.lit(1), F.ceil(n / page)).cast("long").alias("pages"))


def twice_read(first: DataFrame, second: DataFrame, intervals: DataFrame, keys: list[str], *, day: str, id: str) -> DataFrame:
    """(keys, day, n) of two reads of one source, which must hold the same rows on each day, within the key's interval.

    Rows are compared by count and by the sums of two hashes, so neither read is sorted and order doesn't matter. A day on which the reads differ, a row outside
    its key's interval, a key without an interval, and a row without day, key or id fail the job.
    """

    def summed(rows: DataFrame, name: str) -> DataFrame:
        has = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, day, id)))
        rows = require(rows, has, "a row without key, day or id", *keys, day, id)
        text = F.to_json(F.struct(*(F.col(c) for c in sorted(first.columns))), {"ignoreNullFields": "false"})
        sums = (F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in ((text,), (text, F.lit(1))))
        return rows.groupBy(*keys, F.col(day).alias("day")).agg(F.struct(F.count(F.lit(1)).alias("n"), *(s.alias(f"h{i}") for i, s in enumerate(sums))).alias(name))

    both = summed(first, "a").join(summed(second, "b"), [*keys, "day"], "full")
    both = require(both, F.col("a").eqNullSafe(F.col("b")), "two reads differ", *keys, "day", "a.n", F.col("b.n").alias("again"))
    both = both.join(intervals, keys, "left")
    both = require(both, F.coalesce(F.col("day").between(F.col("start"), F.col("end")), F.lit(False)), "a row outside its interval", *keys, "day")
    return both.select(*keys, "day", F.col("a.n").alias("n"))


def collected(first: DataFrame, second: DataFrame, intervals: DataFrame, keys: list[str], *, day: str, id: str, page: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a source that was read twice, and the ranges they were read by.

    An id that occurs twice under a key, in one range or in two, fails the job before a row comes out. An empty source gives no rows and one empty range
    for each interval.
    """
    days = twice_read(first, second, intervals, keys, day=day, id=id)
    ids = first.groupBy(*keys, id).agg(F.count(F.lit(1)).alias("_n"))
    once = require(ids, F.col("_n") == 1, "an id that occurs twice", *keys, id)
    checks = days.agg(F.count(F.lit(1)).alias("d")).crossJoin(once.agg(F.count(F.lit(1)).alias("i")))  # a single row
    return behind(first, checks), ranges(days, intervals, keys, page=page)
