"""Small array expressions the series features are composed of.

All of them stay inside the row: no shuffle, no Python worker. A value that an
element-wise lambda needs (a mean, a sorted copy) is bound with `let` first.
The optimizer may inline a column that is used once into the lambda, which
would compute it again for every element; a bound value is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, with the value computed once per row."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)


def abs_total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + F.abs(v))


def square_total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v * v)


def power_total(gaps: Column, power: int) -> Column:
    """Sum of the elements raised to a small whole power."""

    def step(acc: Column, v: Column) -> Column:
        term = v
        for _ in range(power - 1):
            term = term * v
        return acc + term

    return F.aggregate(gaps, F.lit(0.0), step)


def gaps_from(xs: Column, centre: Column) -> Column:
    """x - centre."""
    return let(centre, lambda c: F.transform(xs, lambda v: v - c))


def steps(xs: Column) -> Column:
    """x[i+1] - x[i]."""
    fewer = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, F.lit(2), fewer), F.slice(xs, F.lit(1), fewer), lambda b, a: b - a)


def at(xs: Column, index: int) -> Column:
    """Element by 0-based index, null outside the array."""
    return F.get(xs, F.lit(index))


def from_end(xs: Column, back: int) -> Column:
    """Element `back` places from the end; 1 is the last."""
    return F.get(xs, F.size(xs) - back)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def how_many(xs: Column, bound: Column, condition: Callable[[Column, Column], Column]) -> Column:
    """Number of elements v for which `condition(v, bound)` holds."""
    return let(bound, lambda b: F.size(F.filter(xs, lambda v: condition(v, b))))


def repeated_values(ordered: Column) -> Column:
    """Each value that occurs more than once, given a sorted array."""
    return let(
        ordered,
        lambda xs: F.array_distinct(F.filter(xs, lambda v, i: v == F.get(xs, i - 1))),
    )


def sorted_quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of a sorted array."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (place - low)


def longest_run(xs: Column, bound: Column, breaks_run: Callable[[Column, Column], Column]) -> Column:
    """Length of the longest stretch without an element that breaks the run."""
    breaks = let(
        bound,
        lambda b: F.transform(xs, lambda v, i: F.when(breaks_run(v, b), i + 1)),
    )
    cuts = F.concat(F.array(F.lit(0)), F.array_compact(breaks), F.array(F.size(xs) + 1))
    return let(cuts, lambda c: F.array_max(steps(c))) - 1


def tail(xs: Column, length: int) -> Column:
    """The last `length` elements, all of them when there are fewer."""
    return F.slice(xs, F.greatest(F.size(xs) - length + 1, F.lit(1)), F.lit(length))


def wider_maxima(xs: Column, maxima: Column, width: int, have: int) -> Column:
    """Maxima over `width` neighbours from those over `have` (have <= width <= 2 * have)."""
    kept = F.greatest(F.size(xs) - width + 1, F.lit(0))
    return F.zip_with(
        F.slice(maxima, F.lit(1), kept), F.slice(maxima, F.lit(1 + width - have), kept), lambda a, b: F.greatest(a, b)
    )


def peaks(xs: Column, maxima: Column, n: int) -> Column:
    """How many elements exceed their n neighbours on either side, given the n-wide maxima.

    Element i has the maxima starting at i - n on its left and i + 1 on its right.
    """
    middle = F.slice(xs, F.lit(n + 1), F.greatest(F.size(xs) - 2 * n, F.lit(0)))
    return let(
        maxima,
        lambda m: F.size(F.filter(middle, lambda v, i: (v > F.get(m, i)) & (v > F.get(m, i + (n + 1))))),
    )


def order_patterns(xs: Column, width: int) -> Column:
    """For each window of `width` elements, its order pattern as one whole number.

    A pattern is fixed by which of every two elements is larger, the earlier
    one coming first on ties. Each element gets a bit per following element
    that is smaller; a window then takes from each of its elements the bits
    that stay within the window.
    """
    starts = F.when(F.size(xs) >= width, F.sequence(F.lit(0), F.size(xs) - width)).otherwise(
        F.array().cast("array<int>")
    )
    falls = F.transform(
        xs, lambda v, i: sum(F.when(v > F.get(xs, i + ahead), 2 ** (ahead - 1)).otherwise(0) for ahead in range(1, width))
    )
    shifts = [sum(range(width - i, width)) for i in range(width - 1)]
    return let(
        falls,
        lambda bits: F.transform(
            starts,
            lambda s: sum(
                F.get(bits, s + i).bitwiseAND(F.lit(2 ** (width - 1 - i) - 1)) * F.lit(2**shift)
                for i, shift in enumerate(shifts)
            ),
        ),
    )


def run_lengths(ordered: Column) -> Column:
    """Lengths of the runs of equal neighbours in a sorted array."""
    ends = let(
        ordered,
        lambda xs: F.array_compact(
            F.transform(xs, lambda v, i: F.when(~v.eqNullSafe(F.get(xs, i + 1)), i + 1))
        ),
    )
    return let(ends, lambda e: steps(F.concat(F.array(F.lit(0)), e)))


def entropy_of_runs(lengths: Column, count: Column) -> Column:
    """-sum p ln p for p = length / count."""
    return let(
        count,
        lambda n: F.aggregate(lengths, F.lit(0.0), lambda acc, c: acc - (c / n) * F.log(c / n)),
    )
