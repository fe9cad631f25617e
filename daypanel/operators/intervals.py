"""Intervals as differences.

An interval adds its measures on its first day and takes them away on the day
after its last, so two rows stand for it however many days it covers. A
running sum inside each entity's row turns the differences into daily values.
Differences are whole numbers or decimals: what was added is taken away
exactly and nothing stays behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daypanel.functions.columns import Expr, add_measures, to_column
from daypanel.sources.spine import as_date

#: Rates are held to 18 digits behind the point; one digit is spare, so that adding two of them keeps all digits.
RATE = T.DecimalType(37, 18)


def covered(start: Expr, days: Expr, lo: str, hi: str, closed: str = "both") -> tuple[Column, Column, Column]:
    """(first day, last day, whether there is any) of an interval inside [lo, hi].

    `closed="both"` covers start..start+days (days + 1 days), `"left"` leaves
    the last one out.
    """
    if closed not in ("both", "left"):
        raise ValueError("closed is 'both' or 'left'")
    first = to_column(start).cast("date")
    last = F.date_add(first, to_column(days).cast("int") - (0 if closed == "both" else 1))
    overlaps = (last >= first) & (last >= as_date(lo)) & (first <= as_date(hi))
    return F.greatest(first, as_date(lo)), F.least(last, as_date(hi)), overlaps


def exact_type(kind: T.DataType) -> T.DataType:
    """The type in which values of a kind are added up without rounding."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(37, kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else RATE


def plain_type(kind: T.DataType) -> T.DataType:
    """The type of a sum of values of a kind."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + 10), kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def measure_types(df: DataFrame, measures: Mapping[str, Expr]) -> dict[str, T.DataType]:
    schema = df.select(*[to_column(v).alias(k) for k, v in measures.items()]).schema
    return {f.name: f.dataType for f in schema.fields}


def interval_deltas(
    df: DataFrame,
    id: str,
    start: Expr,
    days: Expr,
    measures: Mapping[str, Expr],
    lo: str,
    hi: str,
    closed: str = "both",
    known: Mapping[str, str] | None = None,
    covering: str | None = None,
) -> DataFrame:
    """(id, date, measures): at most two rows per interval, whose sums up to a day are the measures of that day.

    An interval that reaches the window's end has no second row. Null measures
    add nothing; `known` names columns for how many intervals with a value
    there are, by measure, and `covering` one for how many intervals.
    """
    first, last, overlaps = covered(start, days, lo, hi, closed)
    types = measure_types(df, measures)
    known = known or {}
    zero = F.lit(0)
    values = {m: F.coalesce(F.col(m).cast(exact_type(types[m])), zero.cast(exact_type(types[m]))) for m in measures}
    values |= {known[m]: F.col(m).isNotNull().cast("long") for m in known}
    values |= {covering: F.lit(1).cast("long")} if covering else {}
    spans = add_measures(df.where(overlaps), measures).select(
        id, first.alias("_first"), last.alias("_last"), *[v.alias(k) for k, v in values.items()]
    )
    begins = F.struct(F.col("_first").alias("date"), F.lit(True).alias("_begins"))
    ends = F.struct(F.date_add("_last", 1).alias("date"), F.lit(False).alias("_begins"))
    changes = F.when(F.col("_last") < as_date(hi), F.array(begins, ends)).otherwise(F.array(begins))
    rows = spans.select("*", F.inline(changes))
    return rows.select(id, "date", *[F.when(F.col("_begins"), F.col(k)).otherwise(-F.col(k)).alias(k) for k in values])


def running_totals(
    entries: Column, keys: Sequence[str], columns: Sequence[str], summed: Sequence[str], types: Mapping[str, T.DataType]
) -> Column:
    """Ordered array of structs in which each column of `summed` becomes its sum over the entries so far."""
    zeros = {c: F.lit(0).cast(types[c]) for c in summed}

    def add(acc: Column, entry: Column) -> Column:
        sums = {c: (acc[c] + entry[c]).cast(types[c]) for c in summed}
        row = F.struct(*[entry[k].alias(k) for k in keys], *[(sums[c] if c in sums else entry[c]).alias(c) for c in columns])
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), *[s.alias(c) for c, s in sums.items()])

    start = F.struct(F.slice(entries, 1, 0).alias("out"), *[z.alias(c) for c, z in zeros.items()])
    return F.aggregate(entries, start, add, lambda acc: acc["out"])


def interval_days(
    df: DataFrame,
    id: str,
    start: Expr,
    days: Expr,
    measures: Mapping[str, Expr],
    lo: str,
    hi: str,
    closed: str = "both",
) -> DataFrame:
    """(id, date, measures): one row per entity and day that an interval covers, with the sums over its intervals.

    What `interval_totals(expand_intervals(...))` gives, but rows are shuffled
    by interval and not by covered day: the differences are reduced to one row
    per (id, day of change) with map-side combine, an entity's changes, at most
    one per day of the window, are summed up in its row, and only then do the
    days appear. Measures without a value on a day are null there. Rates are
    rounded to 18 digits first; values of 10**19 and more are an error.
    """
    types = measure_types(df, measures)
    known = {m: f"_known_{m}" for m in measures}
    columns = [*measures, *known.values(), "_covering"]
    exact = {m: exact_type(types[m]) for m in measures} | {c: T.LongType() for c in columns[len(measures) :]}
    deltas = interval_deltas(df, id, start, days, measures, lo, hi, closed, known, "_covering")
    daily = deltas.groupBy(id, "date").agg(*[F.sum(c).cast(exact[c]).alias(c) for c in columns])
    seen = daily.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("date", *columns))).alias("seen"))
    ran = seen.select(id, running_totals(F.col("seen"), ["date"], columns, columns, exact).alias("ran"))

    def until(entry: Column, i: Column) -> Column:
        after = F.coalesce(F.get(F.col("ran"), i + 1)["date"], F.date_add(as_date(hi), 1))
        return F.struct(*[entry[c].alias(c) for c in ["date", *columns]], F.date_sub(after, 1).alias("_until"))

    stretches = ran.select(id, F.inline(F.transform("ran", until))).where("_covering > 0")
    return stretches.select(
        id,
        F.explode(F.sequence("date", "_until", F.expr("interval 1 day"))).alias("date"),
        *[F.when(F.col(known[m]) > 0, F.col(m).cast(plain_type(types[m]))).alias(m) for m in measures],
    )
