"""Daily totals, interval expansion and the one-row-per-entity panel.

Only sparse rows are shuffled. Events and expanded intervals are reduced to
one row per (id, day) with map-side combine, so a hot entity arrives as at
most one row per day and map task. The dense days are made afterwards, inside
the row of each entity, by filling the gaps between its sparse days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daypanel.functions.columns import Expr, add_measures, to_column
from daypanel.functions.series import let
from daypanel.operators.intervals import covered, exact_type, interval_deltas, measure_types, plain_type, running_totals
from daypanel.sources.spine import as_date, day_count


def daily_totals(
    df: DataFrame, id: str, date: str, sums: Sequence[str] = (), maxes: Sequence[str] = ()
) -> DataFrame:
    """Sum or maximum of each measure per (id, date)."""
    return df.groupBy(id, date).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxes],
    )


def expand_intervals(
    df: DataFrame,
    id: str,
    start: Expr,
    days: Expr,
    measures: Mapping[str, Expr],
    lo: str,
    hi: str,
    closed: str = "both",
) -> DataFrame:
    """One row per interval and covered day, clipped to [lo, hi].

    `closed="both"` covers start..start+days (days + 1 days), `"left"` leaves
    the last one out. Clipping happens before the rows are made, and no join
    with the calendar is needed.
    """
    first, last, overlaps = covered(start, days, lo, hi, closed)
    clipped = F.sequence(first, last, F.expr("interval 1 day"))
    return add_measures(df.where(overlaps), measures).select(
        id, F.explode(clipped).alias("date"), *measures.keys()
    )


def interval_totals(expanded: DataFrame, id: str, measures: Sequence[str]) -> DataFrame:
    """Overlapping intervals add up per (id, day)."""
    return daily_totals(expanded, id, "date", sums=measures)


def combine_daily(
    points: DataFrame,
    spans: DataFrame | None,
    id: str,
    sums: Sequence[str],
    maxes: Sequence[str] = (),
) -> DataFrame:
    """Point events and expanded intervals as one set of daily totals.

    The two sides are stacked and aggregated together: one exchange in place
    of two aggregates and a join.
    """
    if spans is None:
        return daily_totals(points, id, "date", sums, maxes)
    return daily_totals(points.unionByName(spans, allowMissingColumns=True), id, "date", sums, maxes)


def fill_days(
    daily: DataFrame, id: str, date: str, measures: Sequence[str], start: str, end: str, fill=0, running: Sequence[str] = ()
) -> DataFrame:
    """Per id, an array `days` of structs, one for every day from start to end.

    Every id of `daily` appears, also when none of its days is in the window.
    `daily` must hold one row per (id, date), so the collected list is bounded
    by the window. Measures in `running` are differences: each day gets their
    sum over the days up to it.
    """
    n = day_count(start, end)
    types = {f.name: f.dataType for f in daily.schema.fields}
    offset = F.datediff(F.col(date).cast("date"), as_date(start))
    in_window = F.col(date).isNotNull() & offset.between(0, n - 1)
    present = F.struct(
        offset.alias("day"),
        *[F.coalesce(F.col(m), F.lit(fill).cast(types[m])).alias(m) for m in measures],
    )
    sparse = daily.groupBy(id).agg(F.sort_array(F.collect_list(F.when(in_window, present))).alias("seen"))

    if running:
        ran = running_totals(F.col("seen"), ["day"], measures, running, types)
        sparse = sparse.select(id, ran.alias("seen"))

    def empty(before: Column) -> Column:
        """A day without rows, after the entry `before`."""
        held = {m: F.lit(fill).cast(types[m]) for m in measures}
        held |= {m: F.coalesce(before[m], F.lit(0).cast(types[m])) for m in running}
        return F.struct(F.lit(0).alias("day"), *[held[m].alias(m) for m in measures])

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.get(F.col("seen"), i - 1)
        return F.concat(F.array_repeat(empty(before), entry["day"] - F.coalesce(before["day"], F.lit(-1)) - 1), F.array(entry))

    last = F.get(F.col("seen"), F.size("seen") - 1)
    filled = F.concat(
        F.flatten(F.transform("seen", with_gap)),
        F.array_repeat(empty(last), F.lit(n - 1) - F.coalesce(last["day"], F.lit(-1))),
    )
    return sparse.select(id, filled.alias("days"))


def densify(
    daily: DataFrame, id: str, date: str, measures: Sequence[str], start: str, end: str, fill=0
) -> DataFrame:
    """One row per id and day of the window, missing days filled."""
    filled = fill_days(daily, id, date, measures, start, end, fill)
    return filled.select(id, F.posexplode("days").alias("pos", "at")).select(
        id,
        F.date_add(as_date(start), F.col("pos")).alias("date"),
        *[F.col(f"at.{m}").alias(m) for m in measures],
    )


def to_panel(
    daily: DataFrame, id: str, date: str, measures: Sequence[str], start: str, end: str, fill=0, running: Sequence[str] = ()
) -> DataFrame:
    """One row per id, one array per measure, one element per day; `running` as in `fill_days`."""
    filled = fill_days(daily, id, date, measures, start, end, fill, running)
    return filled.select(id, *[F.col(f"days.{m}").alias(m) for m in measures])


def collect_series(long: DataFrame, id: str, date: str, measures: Sequence[str]) -> DataFrame:
    """Panel from an already dense long table, all measures in one aggregate."""
    at = F.sort_array(F.collect_list(F.struct(date, *measures)))
    return long.groupBy(id).agg(at.alias("at")).select(id, *[F.col(f"at.{m}").alias(m) for m in measures])


def carry_maximum(panel: DataFrame, cols: Sequence[str], days: int | None = None) -> DataFrame:
    """Replace each array by its running maximum over the days.

    After the step of width w each element is the maximum of the last 2w; steps
    wider than the array are passed over, so n days cost n log n comparisons.
    `days`, the most elements that an array has, keeps the plan short.
    """

    def widened(xs: Column, width: int) -> Column:
        def step(a: Column) -> Column:
            return F.when(F.size(a) > width, F.transform(a, lambda x, i: F.greatest(x, F.get(a, i - width)))).otherwise(a)

        return let(xs, step)

    def running(name: str) -> Column:
        # An array holds fewer than 2**31 elements.
        widths = 31 if days is None else max(days - 1, 0).bit_length()
        return reduce(widened, [1 << k for k in range(widths)], F.col(name)).alias(name)

    return panel.select(*[running(c) if c in cols else F.col(c) for c in panel.columns])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(cols), var, val)


def series_by_kind(panel: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """(id, kind, series): one row per entity and measure.

    The rows of an entity are made from its own row and stay where that is, so
    what is grouped by `id` before or stored bucketed by it can be grouped so
    again without an exchange.
    """
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("array<double>").alias("series")) for c in cols]
    return panel.select(id, F.explode(F.array(*kinds)).alias("_series")).select(id, "_series.kind", "_series.series")


def panel_to_long(panel: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """(id, kind, time, value): one row per entity, measure and day."""
    return series_by_kind(panel, id, cols).select(id, "kind", F.posexplode("series").alias("time", "value"))


def replicate(df: DataFrame, times: int | Column) -> DataFrame:
    """Every row `times` times."""
    times = F.lit(times) if isinstance(times, int) else times
    copies = df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return copies.drop("_copy")


def running_distinct(df: DataFrame, id: str, date: str, value: str, out: str) -> DataFrame:
    """Per (id, date): how many distinct values were seen up to that date.

    A value counts on the first date it appears; the counts of new values are
    then summed over the dates. The window runs over distinct dates only.
    """
    firsts = df.where(F.col(value).isNotNull()).groupBy(id, value).agg(F.min(date).alias(date))
    fresh = firsts.groupBy(id, date).agg(F.count("*").alias("_new"))
    dates = df.groupBy(id, date).agg(F.lit(0).cast("long").alias("_new"))
    per_day = dates.unionByName(fresh).groupBy(id, date).agg(F.sum("_new").alias("_new"))
    so_far = Window.partitionBy(id).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(id, date, F.sum("_new").over(so_far).alias(out))


def running_max(df: DataFrame, id: str, date: str, value: str, out: str) -> DataFrame:
    """Per (id, date): the largest value up to that date."""
    per_day = df.groupBy(id, date).agg(F.max(value).alias("_top"))
    so_far = Window.partitionBy(id).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(id, date, F.max("_top").over(so_far).alias(out))


def build_panel(
    df: DataFrame,
    id: str,
    date: Expr,
    start: str,
    end: str,
    sums: Mapping[str, Expr],
    maxes: Mapping[str, Expr] | None = None,
    spans: Mapping[str, Expr] | None = None,
    span_filter: Expr | None = None,
    span_days: Expr | None = None,
    carried: Sequence[str] = (),
    closed: str = "both",
    expand: bool = False,
) -> DataFrame:
    """Event lines to panel in one call: point measures plus interval measures.

    Intervals go through the shuffle as differences, two rows each, unless
    `expand` makes a row of every covered day.
    """
    maxes, spans = dict(maxes or {}), dict(spans or {})
    day = to_column(date).cast("date")
    # Days outside the window only prove that the id exists: one row per id is enough.
    points = df.select(
        id,
        F.when(day.between(as_date(start), as_date(end)), day).alias("date"),
        *[to_column(v).alias(k) for k, v in {**sums, **maxes}.items()],
    )
    wide, running, types = None, [], {}
    if spans:
        chosen = df.where(to_column(span_filter)) if span_filter is not None else df
        make = expand_intervals if expand else interval_deltas
        wide = make(chosen, id, day, span_days, spans, start, end, closed)
        if not expand:
            running, types = [*spans], measure_types(chosen, spans)
    measures = [*sums, *maxes, *spans]
    daily = combine_daily(points, wide, id, sums=[*sums, *spans], maxes=list(maxes))
    daily = daily.withColumns({m: F.col(m).cast(exact_type(types[m])) for m in running})
    panel = to_panel(daily, id, "date", measures, start, end, running=running)
    panel = panel.withColumns({m: F.col(m).cast(T.ArrayType(plain_type(types[m]))) for m in running})
    return carry_maximum(panel, carried, day_count(start, end)) if carried else panel
