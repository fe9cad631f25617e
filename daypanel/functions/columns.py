"""Column expressions: code flags, rates, recodes, bins and names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = str | Column


def to_column(value: Expr) -> Column:
    """SQL text or a Column; measures may be given as either."""
    return F.expr(value) if isinstance(value, str) else value


def yes(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def in_codes(col: Expr, codes: Sequence) -> Column:
    """Membership in a code list; unknown counts as not listed."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.isin(list(codes)), F.lit(False))


def any_code(cols: Sequence[str], codes: Sequence) -> Column:
    """True when any of the columns carries a listed code."""
    return reduce(lambda a, b: a | b, [in_codes(c, codes) for c in cols])


def array_has_code(col: Expr, codes: Sequence) -> Column:
    """`any_code` for codes held in one array column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.arrays_overlap(col, F.array(*[F.lit(c) for c in codes])), F.lit(False))


def daily_rate(volume: Expr, days: Expr, *factors: Expr) -> Column:
    """Volume spread over its days, times optional factors; null for zero days."""
    rate = F.try_divide(to_column(volume).cast("double"), to_column(days).cast("double"))
    return reduce(lambda a, b: a * to_column(b), factors, rate)


def bounded(col: Expr, lo, hi) -> Column:
    """The value where it lies in [lo, hi], else null."""
    col = to_column(col)
    return F.when(col.between(lo, hi), col)


def age_at(birth: Expr, at: Expr) -> Column:
    """Whole years between two dates, rounded, with 365.25 days to the year."""
    return F.round(F.datediff(to_column(at), to_column(birth)) / F.lit(365.25)).cast("int")


def bin_labels(
    col: Expr,
    bins: Sequence[tuple[float, float, str]],
    keep: Sequence[str] = (),
    other: str = "Unassigned",
) -> Column:
    """Label a numeric string by closed bins.

    The text is read as a whole number (rounded), text that is no number falls
    through to `keep` (returned as it is) and then to `other`.
    """
    text = to_column(col)
    number = text.try_cast("decimal(10,0)")
    label = F.when(in_codes(text, keep), text).otherwise(F.lit(other)) if keep else F.lit(other)
    for lo, hi, name in reversed(bins):
        label = F.when(number.between(lo, hi), F.lit(name)).otherwise(label)
    return label


def add_measures(df: DataFrame, measures: Mapping[str, Expr]) -> DataFrame:
    """Evaluate a dictionary of named expressions in one projection."""
    return df.withColumns({name: to_column(value) for name, value in measures.items()})


def recode_flags(
    df: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, str],
    present: Sequence = (1, 3),
    prefix: str = "CC_",
) -> DataFrame:
    """Turn status columns into 0/1 flags with readable, prefixed names."""
    flags = [yes(in_codes(old, present)).alias(prefix + new) for old, new in names.items()]
    return df.select(*keys, *flags)


def drop_listed(df: DataFrame, names: Iterable[str], strict: bool = True) -> DataFrame:
    """Drop columns by exact name; an absent or differently cased name is an error."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing and strict:
        raise ValueError(f"columns to drop are absent: {missing}")
    return df.select(*[c for c in df.columns if c not in names])


def keep_columns(
    df: DataFrame,
    always: Sequence[str] = (),
    containing: Sequence[str] = ("CC", "STATIC"),
    series: Sequence[str] = (),
    barred: Sequence[str] = ("Opioid",),
) -> DataFrame:
    """Keep listed columns, columns whose name has a fragment, and chosen series features."""

    def wanted(name: str) -> bool:
        if any(b in name for b in barred):
            return False
        if name in always or any(part in name for part in containing):
            return True
        return bool(series) and "TS" in name and any(part in name for part in series)

    return df.select(*[c for c in df.columns if wanted(c)])


NARROW_TYPES = {
    "TS_CLMLINES": "array<smallint>",
    "TS_MME": "array<float>",
    "TS_FLAG": "array<tinyint>",
    "TS_CUM": "array<smallint>",
}


def narrow_arrays(df: DataFrame, types: Mapping[str, str] = NARROW_TYPES) -> DataFrame:
    """Cast panel arrays to smaller element types by name prefix; others stay."""

    def cast(name: str) -> Column:
        for prefix, kind in types.items():
            if name.startswith(prefix):
                return F.col(name).cast(kind).alias(name)
        return F.col(name)

    return df.select(*[cast(c) for c in df.columns])


def snake_label(text: str) -> str:
    """A category label as a name part: lower case, `_` for space and hyphen."""
    return re.sub(r"\W+", "", text.lower().replace(" ", "_").replace("-", "_"))


def plain_name(text: str) -> str:
    """A column name without punctuation."""
    return re.sub(r"\W+", "", text)


def rename_all(df: DataFrame, rename: Callable[[str], str] = plain_name) -> DataFrame:
    """Rename every column; two names that fall together are an error."""
    names = [rename(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after renaming: {clash}")
    return df.toDF(*names)


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the column's median; one aggregate for all columns."""
    medians = df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in cols]).first().asDict()
    return df.na.fill({c: m for c, m in medians.items() if m is not None})


def trim_outliers(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Rows whose rounded value does not exceed the cap, for every capped column."""
    for name, cap in caps.items():
        df = df.where(F.round(F.col(name), 0) <= cap)
    return df


def rescale(df: DataFrame, col: str, out: str | None = None, minus: float = 0.0, over: float = 1.0) -> DataFrame:
    """(col - minus) / over, replacing the column or under a new name."""
    scaled = ((F.col(col) - F.lit(minus)) / F.lit(over)).alias(out or col)
    return df.select(*[scaled if c == col else F.col(c) for c in df.columns])
