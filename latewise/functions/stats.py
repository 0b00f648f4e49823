"""Tail of the F distribution as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 or more."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz' rule."""
    tiny = F.lit(1e-300)

    def guarded(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1 / guarded(1 + even * state["d"])
        c1 = guarded(1 + even / state["c"])
        half = F.struct(d1.alias("d"), c1.alias("c"), (state["h"] * d1 * c1).alias("h"))
        # The odd half works on the even half's result, held in an array of one so that it is computed once.
        return F.transform(F.array(half), lambda s: F.struct(
            (1 / guarded(1 + odd * s["d"])).alias("d"), guarded(1 + odd / s["c"]).alias("c"),
            (s["h"] * (1 / guarded(1 + odd * s["d"])) * guarded(1 + odd / s["c"])).alias("h"),
        ))[0]

    first = 1 / guarded(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    ms = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double"))
    return F.aggregate(ms, start, step, lambda s: s["h"])


def f_tail(f: Column, df_between: Column, df_within: Column, steps: int = 100) -> Column:
    """The probability of an F statistic of ``f`` or more; null where a degree of freedom is not positive, NaN for NaN."""
    a, b = df_within / 2.0, df_between / 2.0
    total = df_within + df_between * f
    x, y = df_within / total, df_between * f / total
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
    tail = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x, steps) / a).otherwise(
        1 - front * _fraction(b, a, y, steps) / b
    )
    return (
        F.when((df_between <= 0) | (df_within <= 0), None).when(F.isnan(f), float("nan"))
        .when(f <= 0, 1.0).when(f == float("inf"), 0.0).otherwise(tail)
    )
