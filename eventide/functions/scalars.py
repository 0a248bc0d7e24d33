"""Column functions of the readers and rules: boards, price limits, names, layers, buckets, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The day on which ChiNext's limit changed.
CHINEXT_REFORM = "2020-08-24"


def board(code: Column) -> Column:
    return F.when(code.rlike(r"\.BJ$"), "bse").when(code.rlike("^688"), "star").when(code.rlike("^30[01]"), "chinext").otherwise("main")


def limit_pct(board_: Column, is_st: Column, d: Column) -> Column:
    out = F.when(is_st, F.lit("0.05")).when(board_ == "main", F.lit("0.10"))
    out = out.when((board_ == "chinext") & (d < F.lit(CHINEXT_REFORM).cast("date")), F.lit("0.10"))
    return out.when(board_.isin("chinext", "star"), F.lit("0.20")).otherwise(F.lit("0.30")).cast("decimal(4,2)")


def limit_price(pre_close: Column, pct: Column, up: bool) -> Column:
    one = F.lit("1.00").cast("decimal(4,2)")
    return F.round(pre_close * (one + pct if up else one - pct), 2)


def limit_status(open_: Column, high: Column, low: Column, close: Column, pre_close: Column, pct: Column) -> Column:
    """none without a previous close; one_word if one price was traded, and it is a limit; else limit_up, limit_down, none."""
    up, down = limit_price(pre_close, pct, True), limit_price(pre_close, pct, False)
    flat = (open_ == high) & (high == low) & (low == close)
    return (
        F.when(pre_close.isNull() | (pre_close == 0), "none").when(flat & ((close == up) | (close == down)), "one_word")
        .when(close == up, "limit_up").when(close == down, "limit_down").otherwise("none")
    )


def open_limit_status(open_: Column, pre_close: Column, pct: Column) -> Column:
    down, up = limit_price(pre_close, pct, False), limit_price(pre_close, pct, True)
    return F.when(pre_close.isNull() | (pre_close == 0), "none").when(open_ == down, "limit_down").when(open_ == up, "limit_up").otherwise("none")


def name_state(alias: Column) -> Column:
    a = F.trim(alias)
    return (
        F.when(alias.isNull() | (a == ""), "unknown").when(a.endswith("退") | a.startswith("退市"), "delist")
        .when(F.upper(a).contains("ST"), "st").otherwise("normal")
    )


def has_star(alias: Column) -> Column:
    return F.upper(alias).contains("*ST")


def norm_industry(x: Column) -> Column:
    a = F.lower(F.trim(x))
    return F.when(x.isNull() | a.isin("", "nan", "none", "null"), "unknown").otherwise(F.trim(x))


def midpoint(lo: Column, hi: Column) -> Column:
    """The middle of both bounds, else the one there is."""
    return F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(F.coalesce(lo, hi))


def event_id(code: Column, d: Column) -> Column:
    return F.concat_ws(":", code, F.date_format(d, "yyyyMMdd"))


def suffix_bucket(code: Column) -> Column:
    return F.when(code.endswith(".SH"), "SH").when(code.endswith(".SZ"), "SZ").when(code.endswith(".BJ"), "BJ").otherwise("OTHER")


def regime_segment(d: Column) -> Column:
    return F.when(d < F.lit(CHINEXT_REFORM).cast("date"), "pre_10pct").otherwise("post_20pct")


def gap_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "missing").when(days < 0, "negative").when(days == 0, "same_day").when(days <= 3, "1-3").when(days <= 10, "4-10").otherwise("over_10")


def minutes(hhmm: Column) -> Column:
    """Minutes after midnight of a strict HH:MM, else NULL."""
    ok = hhmm.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$")
    parts = F.split(hhmm, ":")
    return F.when(ok, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"))


def beijing_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Shanghai"))


def new_york_close(d: Column) -> Column:
    """The UTC instant of 16:00 in New York on a day."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(d.cast("string"), F.lit(" 16:00:00"))), "America/New_York")


def layer(kind: Column) -> Column:
    """The labels of forecasts by layer; others are dropped by the reader."""
    return F.when(kind.isin("预增", "略增", "续盈"), "good").when(kind.isin("预减", "略减", "首亏", "续亏"), "bad").when(kind == "扭亏", "turnaround")


def parse_ymd(s: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(s), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def parse_number(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit("")).try_cast("decimal(38,10)")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a rate."""
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def cash_per_ten(text: Column) -> Column:
    """Every cash amount per ten shares that a text states."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"每\s*10\s*股[^0-9]{0,12}([0-9]+(?:\.[0-9]+)?)\s*元"), F.lit(1)), lambda x: x.try_cast("decimal(18,4)"))


def amounts_in_yuan(text: Column) -> Column:
    """Amounts with their unit scaled to yuan."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:亿元|万元|元)"), F.lit(0))
    scale = lambda x: F.when(x.contains("亿"), 100_000_000).when(x.contains("万"), 10_000).otherwise(1)
    return F.transform(found, lambda x: F.regexp_replace(x, "[^0-9.]", "").try_cast("decimal(24,4)") * scale(x))
