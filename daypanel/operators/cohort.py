"""Cohort building: labels, eligibility, exclusions and dimension lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.columns import Expr, any_code, to_column, yes


def label_events(
    df: DataFrame,
    code_cols: Sequence[str],
    codes: Sequence,
    date_col: str,
    start,
    end,
    extra: Column | None = None,
    out: str = "target",
) -> DataFrame:
    """1 for rows with a listed code, dated in [start, end], that also meet `extra`.

    A condition that is unknown gives 0, as in SQL's CASE.
    """
    hit = any_code(code_cols, codes) & F.col(date_col).between(start, end)
    return df.withColumn(out, yes(hit if extra is None else hit & extra))


def not_in_codes(col: Expr, codes: Sequence, null_ok: bool = False) -> Column:
    """NOT IN with SQL's null result, or with unknown values let through."""
    col = F.col(col) if isinstance(col, str) else col
    outside = ~col.isin(list(codes))
    return F.coalesce(outside, F.lit(True)) if null_ok else outside


def label_entities(df: DataFrame, id: str, label: str = "target") -> DataFrame:
    """One row per entity: 1 when any of its rows is positive."""
    return df.groupBy(id).agg(F.max(label).alias(label))


def count_lines(df: DataFrame, key: str, condition: Column, out: str = "n", strict: bool = True) -> DataFrame:
    """Lines per key that meet the condition; `strict=False` counts every line."""
    counted = F.count_if(condition) if strict else F.count("*")
    return df.groupBy(key).agg(counted.alias(out))


def enrolled_months(df: DataFrame, id: str, month: str, enrolled: Column, out: str = "months") -> DataFrame:
    """Distinct months per entity in which the enrolment condition holds."""
    months = df.where(enrolled).groupBy(id, month).agg(F.lit(1).alias("_one"))
    return months.groupBy(id).agg(F.count("*").alias(out))


def month_ordinals(df: DataFrame, id: str, month: str, enrolled: Column, out: str = "months") -> DataFrame:
    """One row per entity and month: the month's ordinal where it is enrolled, else null.

    Months are reduced to one row each first, so the window holds at most as
    many rows per entity as there are months.
    """
    months = df.groupBy(id, month).agg(F.max(F.coalesce(enrolled, F.lit(False))).alias("_on"))
    ordinal = F.row_number().over(Window.partitionBy(id).orderBy(month))
    return months.select(id, month, F.when(F.col("_on"), ordinal).alias(out), ordinal.alias("_n")).drop("_n")


def eligible_entities(
    df: DataFrame,
    id: str,
    month: str,
    enrolled: Column,
    min_months: int = 12,
    also: Sequence[tuple[int, Column]] = (),
    always: Column | None = None,
    carried: Sequence[str] = (),
    literal: bool = False,
) -> DataFrame:
    """Entities enrolled for `min_months`, or for fewer under a condition.

    `also` lists (months, condition on the carried columns) alternatives, for
    example eleven months and a death in the twelfth. With `literal=True` the
    test is on the ordinal of single enrolled months, not on their number.
    """
    attributes = [F.max(c).alias(c) for c in carried]
    if literal:
        on_month = month_ordinals(df, id, month, enrolled, "months").where(F.col("months").isNotNull())
        wanted = [min_months, *[n for n, _ in also]]
        counted = on_month.where(F.col("months").isin(wanted)).groupBy(id).agg(
            F.collect_set("months").alias("months")
        )

        def has(n: int) -> Column:
            return F.array_contains("months", n)
    else:
        counted = enrolled_months(df, id, month, enrolled)

        def has(n: int) -> Column:
            return F.col("months") == n

    if carried:
        counted = counted.join(df.groupBy(id).agg(*attributes), id)
    full = has(min_months) if literal else F.col("months") >= min_months
    rule = reduce(lambda a, b: a | b, [has(n) & cond for n, cond in also], full)
    kept = counted.where(rule if always is None else rule & always)
    return kept.select(id, *carried) if literal else kept.select(id, "months", *carried)


def exclude(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in `other`."""
    return df.join(other.select(key), key, "left_anti")


def restrict(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in `other`; never multiplies rows."""
    return df.join(other.select(key), key, "left_semi")


def join_valid(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    at: Column,
    begin: str,
    end: str,
) -> DataFrame:
    """Left join with the dimension entry whose validity range holds the row's value.

    Code equality drives the join and the range is tested on its matches, so
    a code's entries are never gathered; a row without a valid entry is kept.
    """
    inner = {c: f"_dim_{c}" for c in dim.columns}
    entries = dim.withColumnsRenamed(inner)
    valid = F.col("_at").between(F.col(inner[begin]), F.col(inner[end]))
    found = df.withColumn("_at", at).join(entries, (F.col(key) == F.col(inner[dim_key])) & valid, "left")
    return found.select(*df.columns, *[F.col(hidden).alias(c) for c, hidden in inner.items()])


def join_active(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    on: Column,
    begin: str,
    end: str,
    values: Sequence[str],
) -> DataFrame:
    """Left join with the dimension entries active on a fixed date.

    The date filter is applied to the dimension, which is then reduced to one
    row per key (largest value), so that no row is multiplied.
    """
    active = dim.where(on.between(F.col(begin), F.col(end)))
    return df.join(active.groupBy(key).agg(*[F.max(v).alias(v) for v in values]), key, "left")


def full_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join that keeps the key of either side."""
    return a.join(b, key, "full_outer")


def dedupe_counting(df: DataFrame, cols: Sequence[str] | None = None, out: str = "rows_count") -> DataFrame:
    """Distinct rows with the number of copies of each."""
    return df.groupBy(*(cols or df.columns)).agg(F.count("*").alias(out))


def running_values_by_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key, so that a later join on the keys cannot fan out."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def first_per_entity(df: DataFrame, id: str, values: Sequence[Expr]) -> DataFrame:
    """One value per entity, chosen deterministically (the largest)."""
    return df.groupBy(id).agg(*[F.max(to_column(v)).alias(v) for v in values])
