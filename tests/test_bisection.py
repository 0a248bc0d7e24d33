"""Date bisection against a plain walk; what its checks let through and what they stop."""

import datetime as dt

import pytest

from eventide.sources.bisection import collected, ranges

D0 = dt.date(2020, 1, 1)
ROW, SPAN = "code string, day date, id long, v string", "code string, start date, end date"


def day(i):
    return D0 + dt.timedelta(i)


def walk(counts, lo, hi, page):
    n = sum(c for i, c in counts.items() if lo <= i <= hi)
    if n <= page or lo == hi:
        return [(lo, hi, n, max(1, -(-n // page)))], 2 * max(1, -(-n // page))
    mid = lo + (hi - lo) // 2
    a, ra = walk(counts, lo, mid, page)
    b, rb = walk(counts, mid + 1, hi, page)
    return a + b, 1 + ra + rb


def test_ranges_equal_a_walk(spark):
    # a year, a leap year, one day, no rows, a single crowded day, and lengths next to powers of two
    cases = {"a": (365, {i: i * 7 % 11 for i in range(365)}), "b": (366, {0: 3, 365: 40}), "c": (1, {0: 25}), "d": (31, {}), "e": (90, {44: 1000}), "f": (1, {}), "g": (33, {i: 9 for i in range(33)}), "h": (2, {1: 11})}
    days = spark.createDataFrame([(k, day(i), n) for k, (_, c) in cases.items() for i, n in c.items() if n], "code string, day date, n long")
    spans = spark.createDataFrame([(k, D0, day(n - 1)) for k, (n, _) in cases.items()], SPAN)
    got = ranges(days, spans, ["code"], page=10).collect()
    for k, (n, c) in cases.items():
        want, reads = walk(c, 0, n - 1, 10)
        mine = sorted(((r["lo"] - D0).days, (r["hi"] - D0).days, r["n"], r["pages"]) for r in got if r["code"] == k)
        assert mine == want
        assert sum(2 * r[3] for r in mine) + len(mine) - 1 == reads


def run(spark, first, second=None, spans=(("a", day(0), day(9)),)):
    rows = lambda x: spark.createDataFrame(x, ROW)
    got, leaves = collected(rows(first), rows(first if second is None else second), spark.createDataFrame(list(spans), SPAN), ["code"], day="day", id="id", page=2)
    return sorted(map(tuple, got.collect())), leaves.collect()


GOOD = [("a", day(0), 1, "x"), ("a", day(0), 2, None), ("a", day(0), 3, "z"), ("a", day(7), 4, "x")]


def test_rows_come_whole(spark):
    rows, leaves = run(spark, GOOD, GOOD[::-1])
    assert rows == sorted(GOOD)
    assert sum(r["n"] for r in leaves) == 4 and max(r["pages"] for r in leaves) == 2
    rows, leaves = run(spark, [])
    assert rows == [] and [(r["n"], r["pages"]) for r in leaves] == [(0, 1)]


@pytest.mark.parametrize(
    "first, second, message",
    [
        (GOOD, GOOD[1:], "two reads differ"),  # a row less
        (GOOD, [*GOOD[:3], ("a", day(7), 4, "y")], "two reads differ"),  # another value
        (GOOD, [*GOOD[:3], ("a", day(8), 4, "x")], "two reads differ"),  # another day
        (GOOD, [*GOOD, ("a", day(9), 5, "x")], "two reads differ"),  # a day more
        ([*GOOD, ("a", day(7), 1, "x")], None, "an id that occurs twice"),  # in two ranges
        ([*GOOD, GOOD[0]], None, "an id that occurs twice"),  # a whole row again
        ([*GOOD, ("a", day(10), 5, "x")], None, "outside its interval"),
        ([*GOOD, ("b", day(1), 5, "x")], None, "outside its interval"),  # a key without an interval
        ([*GOOD, ("a", None, 5, "x")], None, "without key, day or id"),
        ([*GOOD, ("a", day(1), None, "x")], None, "without key, day or id"),
    ],
)
def test_a_broken_read_gives_no_rows(spark, first, second, message):
    with pytest.raises(Exception, match=message):
        run(spark, first, second)


def test_an_id_may_recur_under_another_key(spark):
    rows, _ = run(spark, [*GOOD, ("b", day(1), 1, "x")], spans=[("a", day(0), day(9)), ("b", day(0), day(3))])
    assert len(rows) == 5
