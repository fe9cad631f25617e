"""Tail probability of the F distribution, as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from daypanel.functions.columns import Expr
from daypanel.functions.series import let

#: Half steps that the continued fraction may take.
HALF_STEPS = 1000
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """log(gamma(x)) for x > 0: Stirling's series, ten places further up."""
    z = x + 10
    # Bernoulli numbers over 2k (2k - 1).
    terms = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
    series = sum((c / F.pow(z, 2 * k + 1) for k, c in enumerate(terms)), F.lit(0.0))
    further = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    # The product of ten factors stays finite up to 10**30; beyond that the sum of their logarithms is that of their largest.
    return further - F.when(x < 1e20, F.log(product)).otherwise(10 * F.log(x))


def log_gamma_ratio(x: Column, d: Column) -> Column:
    """log(gamma(x + d) / gamma(x)); by its series where the difference of two large logarithms would lose digits."""
    middle = x + (d - 1) / 2
    series = d * F.log(middle) + d * (1 - d * d) / (24 * middle * middle)
    return F.when((x < 1e3) | (d * d > 1e-2 * x), log_gamma(x + d) - log_gamma(x)).otherwise(series)


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _beta_fraction(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Incomplete beta function where its continued fraction (Lentz) converges fast; `rest` is 1 - x with all its digits."""
    log_x = F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.log(x))
    log_rest = F.when(x < 0.5, F.log1p(-x)).otherwise(F.log(rest))
    small = F.least(a, b)
    log_front = log_gamma_ratio(F.greatest(a, b), small) - log_gamma(small) + a * log_x + b * log_rest

    def step(at: Column, half: Column) -> Column:
        m = F.floor((half + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(half % 2 == 1, even).otherwise(odd)
        d = 1 / _away_from_zero(1 + term * at["d"])
        c = _away_from_zero(1 + term / at["c"])
        moved = F.struct(
            c.alias("c"),
            d.alias("d"),
            (at["fraction"] * c * d).alias("fraction"),
            ((half % 2 == 0) & (F.abs(c * d - 1) < 1e-15)).alias("done"),
        )
        return F.when(at["done"], at).otherwise(moved)

    d = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("fraction"), F.lit(False).alias("done"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(HALF_STEPS)), start, step, lambda at: at["fraction"])
    return F.exp(log_front) * fraction / a


def incomplete_beta(a: Expr, b: Expr, x: Expr, rest: Expr | None = None) -> Column:
    """Regularised incomplete beta function; `rest` is 1 - x, for x so near 1 that the difference has lost digits."""
    a, b, x = ((F.col(v) if isinstance(v, str) else v).cast("double") for v in (a, b, x))
    rest = 1 - x if rest is None else (F.col(rest) if isinstance(rest, str) else rest).cast("double")
    # Near 1 the fraction loses digits; where the result is no small number its complement keeps them.
    turned = (x > (a + 1) / (a + b + 2)) | (x > 0.5) & (a * rest < 5)
    pick = lambda one, two: F.when(turned, one).otherwise(two)
    given = F.struct(
        pick(b, a).alias("a"), pick(a, b).alias("b"), pick(rest, x).alias("x"), pick(x, rest).alias("rest"), turned.alias("turned")
    )

    def value(v: Column) -> Column:
        tail = _beta_fraction(v["a"], v["b"], v["x"], v["rest"])
        return let(tail, lambda t: F.when(v["turned"], 1 - t).otherwise(t))

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(let(given, value))


def f_tail(f: Expr, df1: Expr, df2: Expr) -> Column:
    """P(F > f) with df1 and df2 degrees of freedom; null without f or residual degrees of freedom."""
    f, df1, df2 = ((F.col(v) if isinstance(v, str) else v).cast("double") for v in (f, df1, df2))
    whole = df2 + df1 * f
    beta = incomplete_beta(df2 / 2, df1 / 2, df2 / whole, df1 * f / whole)
    return F.when(F.isnan(f) | (df2 <= 0), None).when(f == float("inf"), 0.0).when(f.isNotNull(), beta)
