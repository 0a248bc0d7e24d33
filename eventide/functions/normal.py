"""The normal distribution as column expressions (A18): everything stays in the JVM.

The distribution function is a power series near the middle and a continued fraction in the tails, both to the last bit or nearly; the
quantile is a rational first guess that two of Halley's steps make as exact as the distribution function. cdf_sql() and quantile_sql() say the same for another engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series (below SPLIT) and levels of the continued fraction (beyond it).
TERMS, LEVELS, SPLIT = 60, 80, 3.0
#: The rational approximation of the quantile in t = sqrt(-2 ln q), good to 0.00045.
ABOVE, BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)
ROOT = math.sqrt(2 * math.pi)


def let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def density(z: Column) -> Column:
    return F.exp(-z * z / 2) / ROOT


def upper_tail(z: Column) -> Column:
    """The mass above z, for z >= 0."""
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.struct(z.alias("term"), z.alias("total")),
        lambda a, k: F.struct((a.term * z * z / (2 * k + 1)).alias("term"), (a.total + a.term * z * z / (2 * k + 1)).alias("total")),
    ).total
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / a)
    return F.when(z < SPLIT, F.lit(0.5) - density(z) * grown).otherwise(density(z) / fraction)


def normal_cdf(z: Column) -> Column:
    """The mass below z."""
    return let(z.cast("double"), lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, upper_tail(-x)).otherwise(1 - upper_tail(x)))


def normal_quantile(p: Column) -> Column:
    """The point below which the mass is p; a p that isn't strictly between 0 and 1 fails the job, NULL stays NULL."""
    p = p.cast("double")
    good = F.when(p.isNull() | ((p > 0) & (p < 1)), p).otherwise(F.raise_error(F.concat(F.lit("no quantile of "), p.cast("string"))).cast("double"))

    def found(p: Column) -> Column:
        q = F.least(p, 1 - p)
        t = F.sqrt(-2 * F.ln(q))
        x = let(t, lambda t: t - _poly(ABOVE, t) / _poly(BELOW, t))
        for _ in range(2):
            x = let(F.greatest(x, F.lit(0.0)), lambda x: let((upper_tail(x) - q) / density(x), lambda u: x + u / (1 - x * u / 2)))
        return F.when(p.isNull(), F.lit(None).cast("double")).when(p < 0.5, -x).otherwise(x)

    return let(good, found)


def _poly(coefficients: tuple[float, ...], t: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * t + c
    return out


def _poly_sql(coefficients: tuple[float, ...], t: str) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * {t} + {c!r})"
    return out


def _tail_sql(z: str) -> str:
    """The mass above a name z >= 0, in DuckDB's SQL."""
    step = f"a.term * {z} * {z} / (2 * b.k + 1)"
    terms = f"list_transform(range(1, {TERMS + 1}), lambda k: {{'k': k::DOUBLE, 'term': 0.0::DOUBLE, 'total': 0.0::DOUBLE}})"
    grown = f"list_reduce(list_prepend({{'k': 0.0::DOUBLE, 'term': {z}, 'total': {z}}}, {terms}), lambda a, b: {{'k': b.k, 'term': {step}, 'total': a.total + {step}}}).total"
    fraction = f"list_reduce(list_concat([{z}], range({LEVELS}, 0, -1)::DOUBLE[]), lambda a, k: {z} + k / a)"
    d = f"exp(-{z} * {z} / 2) / {ROOT!r}"
    return f"(CASE WHEN {z} < {SPLIT} THEN 0.5 - {d} * {grown} ELSE {d} / {fraction} END)"


def cdf_sql(z: str) -> str:
    """normal_cdf() of an expression, in DuckDB's SQL."""
    return f"list_transform([({z})::DOUBLE], lambda z0: list_transform([abs(z0)], lambda z1: CASE WHEN z0 < 0 THEN {_tail_sql('z1')} ELSE 1 - {_tail_sql('z1')} END)[1])[1]"


def quantile_sql(p: str) -> str:
    """normal_quantile() of an expression, in DuckDB's SQL."""
    start = f"list_transform([sqrt(-2 * ln(q0))], lambda t0: t0 - {_poly_sql(ABOVE, 't0')} / {_poly_sql(BELOW, 't0')})[1]"
    x = start
    for i in range(2):
        x = f"list_transform([greatest({x}, 0.0)], lambda x{i}: list_transform([({_tail_sql(f'x{i}')} - q0) / (exp(-x{i} * x{i} / 2) / {ROOT!r})], lambda u{i}: x{i} + u{i} / (1 - x{i} * u{i} / 2))[1])[1]"
    return f"list_transform([({p})::DOUBLE], lambda p0: list_transform([least(p0, 1 - p0)], lambda q0: CASE WHEN p0 < 0.5 THEN -({x}) ELSE {x} END)[1])[1]"
