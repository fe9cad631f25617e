"""Features of the panel series, 71 per series, and the abridged set.

The work is done on (id, kind, series) rows, so that there are 71 expressions
whatever the number of measures. Shared pieces (mean, sorted copy, steps,
quantiles, sliding maxima) are made in earlier projections and referred to by
name; Catalyst keeps such projections apart because their expressions are
referenced more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions import series as S
from daypanel.functions.columns import plain_name
from daypanel.operators.panel import series_by_kind

# The feature parameters.
QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
PEAK_SUPPORTS = [1, 3, 5, 10, 50]
CHANGE_CORRIDORS = [(0.6, 0.8), (0.6, 1.0), (0.8, 1.0)]
ENERGY_CHUNKS = 10
SIGMA_MULTIPLES = [0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10]
HIGH_LEVEL = 90
LOW_LEVEL = 89
PATTERN_WIDTH = 7
LARGEST_COUNT = 10
TAIL_DAYS = 30

# Sums of squares below this are rounding error of a constant series.
FLAT = 1e-14

# Intermediate peak windows: each is at most twice the one it is built from.
_PEAK_LADDER = {2: 1, 3: 2, 4: 2, 5: 4, 8: 4, 10: 8, 16: 8, 32: 16, 50: 32}


def _q_name(q: float) -> str:
    return f"q{round(q * 100):03d}"


def _with_moments(df: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    x = F.col("series")
    first = df.withColumns(
        {
            "n": F.size(x),
            "s1": S.total(x),
            "energy": S.square_total(x),
            "lo": F.array_min(x),
            "hi": F.array_max(x),
            "ordered": F.sort_array(x),
            "d": S.steps(x),
        }
    )
    second = first.withColumns(
        {
            # Kept within the range of the series, so that a constant one has no rounding residue.
            "mu": F.greatest("lo", F.least("hi", F.try_divide("s1", F.col("n").cast("double")))),
            "abs_d": S.abs_total(F.col("d")),
            "distinct": F.size(F.array_distinct("ordered")),
            "repeated": S.repeated_values(F.col("ordered")),
            **{_q_name(q): S.sorted_quantile(F.col("ordered"), q) for q in quantiles},
        }
    )
    third = second.withColumn("gaps", S.gaps_from(x, F.col("mu")))
    fourth = third.withColumn("m2", S.square_total(F.col("gaps")))
    return fourth.withColumns(
        {
            "var": F.try_divide("m2", F.col("n").cast("double")),
            "sd": F.sqrt(F.try_divide("m2", F.col("n").cast("double"))),
            "m3": S.power_total(F.col("gaps"), 3),
            "m4": S.power_total(F.col("gaps"), 4),
        }
    )


def _needed_quantiles(features: Sequence[str]) -> list[float]:
    """Quantiles that the features use; each costs analysis time even where it is pruned later."""
    needed = {0.5} if "median" in features else set()
    needed |= {q for q in QUANTILES if f"quantile__q_{q}" in features}
    if any(f.startswith("change_quantiles") for f in features):
        needed |= {q for pair in CHANGE_CORRIDORS for q in pair}
    return sorted(needed)


def _with_peak_maxima(df: DataFrame) -> DataFrame:
    out = df.withColumn("max1", F.col("series"))
    for width, have in _PEAK_LADDER.items():
        out = out.withColumn(f"max{width}", S.wider_maxima(F.col("series"), F.col(f"max{have}"), width, have))
    return out


def _with_patterns(df: DataFrame) -> DataFrame:
    sorted_patterns = F.sort_array(S.order_patterns(F.col("series"), PATTERN_WIDTH))
    return df.withColumn("patterns", sorted_patterns).withColumn("runs", S.run_lengths(F.col("patterns")))


def _skewness(n: Column, m2: Column, m3: Column) -> Column:
    """Adjusted Fisher-Pearson skewness: null below 3 elements, 0 for a constant series."""
    g1 = F.try_divide(m3 / n, F.pow(m2 / n, F.lit(1.5)))
    return F.when(n < 3, None).when(m2 < FLAT, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _kurtosis(n: Column, m2: Column, m4: Column) -> Column:
    """Adjusted excess kurtosis: null below 4 elements, 0 for a constant series."""
    g2 = F.try_divide(m4 / n, F.pow(m2 / n, F.lit(2.0))) - 3
    return F.when(n < 4, None).when(m2 < FLAT, 0.0).otherwise(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _place(position: Column, n: Column) -> Column:
    """A 1-based position as a relative location; null where nothing was found."""
    return S.share(F.when(position > 0, position - 1), n)


def _last_place(found_reversed: Column, n: Column) -> Column:
    return F.lit(1.0) - _place(found_reversed, n)


def _corridor_change(lo: float, hi: float) -> Column:
    """Mean absolute step between neighbours that both lie between two quantiles."""
    floor, ceiling, x = F.col(_q_name(lo)), F.col(_q_name(hi)), F.col("series")
    inside = S.let(
        floor,
        lambda f: S.let(
            ceiling, lambda c: F.transform(x, lambda v: F.when((v >= f) & (v <= c), v))
        ),
    )
    moves = S.let(inside, lambda kept: F.array_compact(S.steps(kept)))
    mean_move = S.let(moves, lambda m: F.coalesce(S.share(S.abs_total(m), F.size(m)), F.lit(0.0)))
    return F.when(F.size(x) == 0, None).when(floor == ceiling, 0.0).otherwise(mean_move)


def _chunk_energy(i: int) -> Column:
    """Energy share of chunk i; the first n mod k chunks have one element more."""
    n = F.col("n")
    small = F.floor(n / ENERGY_CHUNKS).cast("int")
    larger = F.pmod(n, F.lit(ENERGY_CHUNKS))
    start = small * i + F.least(F.lit(i), larger)
    length = small + F.when(F.lit(i) < larger, 1).otherwise(0)
    return F.try_divide(S.square_total(F.slice("series", start + 1, length)), F.col("energy"))


def _slope() -> Column:
    n = F.col("n")
    pairs = S.let((n - 1) / 2, lambda middle: F.transform("series", lambda v, i: (i - middle) * v))
    spread = n * (n * n - 1) / F.lit(12.0)
    return F.try_divide(S.total(pairs), spread)


def feature_columns() -> dict[str, Callable[[], Column]]:
    """Name to expression maker for every feature, over the prepared columns."""
    x, n, d = F.col("series"), F.col("n"), F.col("d")
    mu, sd, m2 = F.col("mu"), F.col("sd"), F.col("m2")
    hi, lo = F.col("hi"), F.col("lo")
    backwards = F.reverse(x)

    def second_derivative() -> Column:
        ends = S.from_end(x, 1) - S.from_end(x, 2) - S.at(x, 1) + S.at(x, 0)
        return F.when(n > 2, ends / (2 * (n - 2)))

    out = {
        "abs_energy": lambda: F.col("energy"),
        "maximum": lambda: hi,
        "minimum": lambda: lo,
        "mean": lambda: mu,
        "median": lambda: F.col(_q_name(0.5)),
        "standard_deviation": lambda: sd,
        "sum_values": lambda: F.col("s1"),
        "mean_abs_change": lambda: S.share(F.col("abs_d"), F.size(d)),
        "mean_change": lambda: S.share(S.from_end(x, 1) - S.at(x, 0), n - 1),
        "mean_second_derivative_central": second_derivative,
        "has_duplicate_max": lambda: (S.how_many(x, hi, lambda v, b: v == b) >= 2).cast("double"),
        "has_duplicate_min": lambda: (S.how_many(x, lo, lambda v, b: v == b) >= 2).cast("double"),
        "variation_coefficient": lambda: F.try_divide(sd, mu),
        "variance": lambda: F.col("var"),
        "skewness": lambda: _skewness(n, m2, F.col("m3")),
        "kurtosis": lambda: _kurtosis(n, m2, F.col("m4")),
        "root_mean_square": lambda: F.sqrt(S.share(F.col("energy"), n)),
        "absolute_sum_of_changes": lambda: F.col("abs_d"),
        "longest_strike_below_mean": lambda: S.longest_run(x, mu, lambda v, m: v >= m).cast("double"),
        "longest_strike_above_mean": lambda: S.longest_run(x, mu, lambda v, m: v <= m).cast("double"),
        "count_above_mean": lambda: S.how_many(x, mu, lambda v, m: v > m).cast("double"),
        "count_below_mean": lambda: S.how_many(x, mu, lambda v, m: v < m).cast("double"),
        "last_location_of_maximum": lambda: _last_place(F.array_position(backwards, hi), n),
        "first_location_of_maximum": lambda: _place(F.array_position(x, hi), n),
        "last_location_of_minimum": lambda: _last_place(F.array_position(backwards, lo), n),
        "first_location_of_minimum": lambda: _place(F.array_position(x, lo), n),
        "percentage_of_reoccurring_values_to_all_values": lambda: S.share(F.size("repeated"), F.col("distinct")),
        "sum_of_reoccurring_values": lambda: S.total(F.col("repeated")),
        "ratio_value_number_to_time_series_length": lambda: S.share(F.col("distinct"), n),
        "cid_ce__normalize_true": lambda: F.when(sd == 0, 0.0).otherwise(
            F.try_divide(F.sqrt(S.square_total(d)), sd)
        ),
    }
    out |= {f"quantile__q_{q}": lambda q=q: F.col(_q_name(q)) for q in QUANTILES}
    out |= {f"number_peaks__n_{k}": lambda k=k: S.peaks(x, F.col(f"max{k}"), k).cast("double") for k in PEAK_SUPPORTS}
    out |= {
        f"change_quantiles__f_agg_mean__isabs_true__qh_{b}__ql_{a}": lambda a=a, b=b: _corridor_change(a, b)
        for a, b in CHANGE_CORRIDORS
    }
    out |= {"linear_trend__attr_slope": _slope}
    out |= {
        f"energy_ratio_by_chunks__num_segments_{ENERGY_CHUNKS}__segment_focus_{i}": lambda i=i: _chunk_energy(i)
        for i in range(ENERGY_CHUNKS)
    }
    out |= {
        f"ratio_beyond_r_sigma__r_{r}": lambda r=r: S.share(
            S.how_many(F.col("gaps"), sd * r, lambda gap, far: F.abs(gap) > far), n
        )
        for r in SIGMA_MULTIPLES
    }
    out |= {
        f"count_above__t_{HIGH_LEVEL}": lambda: S.share(F.size(F.filter(x, lambda v: v >= HIGH_LEVEL)), n),
        f"count_below__t_{LOW_LEVEL}": lambda: S.share(F.size(F.filter(x, lambda v: v <= LOW_LEVEL)), n),
        f"permutation_entropy__dimension_{PATTERN_WIDTH}__tau_1": lambda: F.when(
            F.size("patterns") > 0, S.entropy_of_runs(F.col("runs"), F.size("patterns"))
        ),
        f"mean_n_absolute_max__number_of_maxima_{LARGEST_COUNT}": lambda: F.when(
            n > LARGEST_COUNT,
            S.total(S.tail(F.sort_array(F.transform(x, lambda v: F.abs(v))), LARGEST_COUNT)) / LARGEST_COUNT,
        ),
    }
    return out


ALL_FEATURES = (
    [
        "abs_energy",
        "maximum",
        "minimum",
        "mean",
        "median",
        "standard_deviation",
        "sum_values",
        "mean_abs_change",
        "mean_change",
        "mean_second_derivative_central",
        "has_duplicate_max",
        "has_duplicate_min",
        "variation_coefficient",
        "variance",
        "skewness",
        "kurtosis",
        "root_mean_square",
        "absolute_sum_of_changes",
        "longest_strike_below_mean",
        "longest_strike_above_mean",
        "count_above_mean",
        "count_below_mean",
        "last_location_of_maximum",
        "first_location_of_maximum",
        "last_location_of_minimum",
        "first_location_of_minimum",
        "percentage_of_reoccurring_values_to_all_values",
        "sum_of_reoccurring_values",
        "ratio_value_number_to_time_series_length",
        "cid_ce__normalize_true",
    ]
    + [f"quantile__q_{q}" for q in QUANTILES]
    + [f"number_peaks__n_{k}" for k in PEAK_SUPPORTS]
    + [f"change_quantiles__f_agg_mean__isabs_true__qh_{b}__ql_{a}" for a, b in CHANGE_CORRIDORS]
    + ["linear_trend__attr_slope"]
    + [f"energy_ratio_by_chunks__num_segments_{ENERGY_CHUNKS}__segment_focus_{i}" for i in range(ENERGY_CHUNKS)]
    + [f"ratio_beyond_r_sigma__r_{r}" for r in SIGMA_MULTIPLES]
    + [
        f"count_above__t_{HIGH_LEVEL}",
        f"count_below__t_{LOW_LEVEL}",
        f"permutation_entropy__dimension_{PATTERN_WIDTH}__tau_1",
        f"mean_n_absolute_max__number_of_maxima_{LARGEST_COUNT}",
    ]
)


def series_features(by_kind: DataFrame, keys: Sequence[str], features: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Features of a `series` array column; column pruning leaves out what `features` does not use."""
    prepared = _with_moments(by_kind, _needed_quantiles(features))
    if any(f.startswith("number_peaks") for f in features):
        prepared = _with_peak_maxima(prepared)
    if any(f.startswith("permutation_entropy") for f in features):
        prepared = _with_patterns(prepared)
    made = feature_columns()
    return prepared.select(*keys, *[made[f]().alias(f) for f in features])


def extract_features(
    panel: DataFrame, id: str, cols: Sequence[str], features: Sequence[str] = ALL_FEATURES
) -> DataFrame:
    """(id, kind, one column per feature) from the panel's array columns."""
    return series_features(series_by_kind(panel, id, cols), [id, "kind"], features)


def pivot_features(long: DataFrame, id: str, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """One row per id, one column `{kind}__{feature}` per kind and feature.

    All features of a kind are one struct, so the aggregate has one expression
    per kind. Where the features were made of a panel that is grouped or
    bucketed by `id` (`extract_features`), they meet without an exchange. Of
    rows that repeat id and kind the largest stays, in order of the features.
    """
    names = [c for c in long.columns if c not in (id, kind)]
    row = F.struct(*[F.col(f"`{f}`") for f in names])
    places = {k: f"_kind_{i}" for i, k in enumerate(kinds)}
    met = long.groupBy(id).agg(*[F.max(F.when(F.col(kind) == k, row)).alias(p) for k, p in places.items()])
    return met.select(id, *[F.col(p)[f].alias(feature_name(k, f)) for k, p in places.items() for f in names])


def pivot_long(long: DataFrame, id: str, variable: str, value: str, names: Sequence[str]) -> DataFrame:
    """(id, variable, value) rows to one column per variable; `names` spares a distinct job."""
    return long.groupBy(id).pivot(variable, list(names)).agg(F.sum(value))


def feature_name(kind: str, feature: str) -> str:
    """Column name without punctuation: `q_0.1` becomes `q_01`."""
    return plain_name(f"{kind}__{feature}")


def abridged_features(
    panel: DataFrame, id: str, cols: Sequence[str], tail: int = TAIL_DAYS, keep: Sequence[str] = ()
) -> DataFrame:
    """Mean and population variance of each series, whole and over its tail; `keep` names columns that stay beside them."""
    halves = {"": lambda c: F.col(c).cast("array<double>"), f"_{tail}_day": lambda c: S.tail(F.col(c), tail).cast("array<double>")}
    kept = [F.col(f"`{c}`") for c in keep]
    arrays = panel.select(id, *kept, *[cut(c).alias(f"{c}{end}") for c in cols for end, cut in halves.items()])
    with_means = arrays.withColumns(
        {f"{c}__mean{end}": S.share(S.total(F.col(f"{c}{end}")), F.size(f"{c}{end}")) for c in cols for end in halves}
    )
    columns: list[Column] = []
    for c in cols:
        for end in halves:
            mean = F.col(f"{c}__mean{end}")
            spread = S.share(S.square_total(S.gaps_from(F.col(f"{c}{end}"), mean)), F.size(f"{c}{end}"))
            columns += [mean, spread.alias(f"{c}__variance{end}")]
    return with_means.select(id, *kept, *columns)
