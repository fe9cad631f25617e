"""Tail of the F distribution in plain Python, for comparison."""

from __future__ import annotations
import math




def log_gamma_ratio(x: float, d: float) -> float:
    """log(gamma(x + d) / gamma(x)); by its series where the difference of two large logarithms would lose digits."""
    if x < 1e5 or d * d > 1e-2 * x:
        return math.lgamma(x + d) - math.lgamma(x)
    middle = x + (d - 1) / 2
    return d * math.log(middle) + d * (1 - d * d) / (24 * middle * middle)


def incomplete_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    # Near 1 the fraction loses digits; where the result is no small number its complement keeps them.
    if x > (a + 1) / (a + b + 2) or x > 0.5 and a * rest < 5:
        return 1.0 - _beta_fraction(b, a, rest, x)
    return _beta_fraction(a, b, x, rest)


def _beta_fraction(a: float, b: float, x: float, rest: float) -> float:
    log_x = math.log1p(-rest) if rest < 0.5 else math.log(x)
    log_rest = math.log1p(-x) if x < 0.5 else math.log(rest)
    large, small = max(a, b), min(a, b)
    log_front = log_gamma_ratio(large, small) - math.lgamma(small) + a * log_x + b * log_rest
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    fraction = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        moved = 1.0
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            moved = c * d
            fraction *= moved
        if abs(moved - 1.0) < 1e-15:
            break
    return math.exp(log_front) * fraction / a


def f_tail_value(f: float, df1: float, df2: float) -> float | None:
    """P(F > f) with df1 and df2 degrees of freedom."""
    if f is None or math.isnan(f) or df2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))
