"""Series features on the event panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daypanel.operators import features as X
from daypanel.plans.registry import query, rounded
from daypanel.plans.standins import LONG, SERIES, STATS, TAIL, event_panel

DIGITS = 4


def _features(spark: SparkSession, where: str, names: list[str]) -> DataFrame:
    made = X.extract_features(event_panel(spark, where), "user_id", SERIES, names)
    plain = made.toDF("user_id", "kind", *[X.plain_name(n) for n in names])
    return rounded(plain, DIGITS)


_PARTS: list[tuple[list[str], str]] = []


def _register(name: str, features: list[str], sql: str) -> None:
    _PARTS.append((features, sql))
    query(name, sql)(lambda spark, where: _features(spark, where, features))


def _r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{_r(e)} AS {n}" for n, e in columns.items())


_BASIC = {
    "abs_energy": "sum(x * x)",
    "maximum": "max(x)",
    "minimum": "min(x)",
    "mean": "sum(x) / count(*)",
    "median": "quantile_cont(x, 0.5)",
    "standard_deviation": "sqrt(sum((x - mu) * (x - mu)) / count(*))",
    "sum_values": "sum(x)",
    "variation_coefficient": "CASE WHEN max(mu) <> 0 THEN sqrt(sum((x - mu) * (x - mu)) / count(*)) / max(mu) END",
    "variance": "sum((x - mu) * (x - mu)) / count(*)",
    "root_mean_square": "sqrt(sum(x * x) / count(*))",
}
_register(
    "feat_basic",
    list(_BASIC),
    f"WITH {STATS} SELECT user_id, kind, {_select(_BASIC)} FROM long JOIN stats USING (user_id, kind) GROUP BY user_id, kind",
)

_register(
    "feat_moments",
    ["skewness", "kurtosis"],
    f"""WITH {LONG} SELECT user_id, kind,
    {_r("CASE WHEN min(x) = max(x) THEN 0 ELSE skewness(x) END")} AS skewness,
    {_r("CASE WHEN min(x) = max(x) THEN 0 ELSE kurtosis(x) END")} AS kurtosis
    FROM long GROUP BY user_id, kind""",
)

_STEPS = f"""{STATS}, moves AS (SELECT user_id, kind, t, x, x - lag(x) OVER (PARTITION BY user_id, kind ORDER BY t) AS d FROM long)"""
_CHANGES = {
    "mean_abs_change": "avg(abs(d))",
    "mean_change": "(max_by(x, t) - min_by(x, t)) / (count(*) - 1)",
    "mean_second_derivative_central": """(max_by(x, t) - max(CASE WHEN t = n - 2 THEN x END)
        - max(CASE WHEN t = 1 THEN x END) + min_by(x, t)) / (2 * (count(*) - 2))""",
    "absolute_sum_of_changes": "sum(abs(d))",
    "cid_ce__normalize_true": """CASE WHEN min(x) = max(x) THEN 0
        ELSE sqrt(sum(d * d)) / sqrt(sum((x - mu) * (x - mu)) / count(*)) END""",
}
_register(
    "feat_changes",
    list(_CHANGES),
    f"WITH {_STEPS} SELECT user_id, kind, {_select(_CHANGES)} FROM moves JOIN stats USING (user_id, kind) GROUP BY user_id, kind",
)

_DUPLICATES = {
    "has_duplicate_max": "CASE WHEN sum(CASE WHEN x = hi THEN c ELSE 0 END) >= 2 THEN 1 ELSE 0 END",
    "has_duplicate_min": "CASE WHEN sum(CASE WHEN x = lo THEN c ELSE 0 END) >= 2 THEN 1 ELSE 0 END",
    "percentage_of_reoccurring_values_to_all_values": "count(*) FILTER (WHERE c > 1) / count(*)",
    "sum_of_reoccurring_values": "coalesce(sum(x) FILTER (WHERE c > 1), 0)",
    "ratio_value_number_to_time_series_length": "count(*) / sum(c)",
}
_register(
    "feat_duplicates",
    list(_DUPLICATES),
    f"""WITH {STATS}, vals AS (SELECT user_id, kind, x, count(*) AS c FROM long GROUP BY user_id, kind, x)
    SELECT user_id, kind, {_select(_DUPLICATES)} FROM vals JOIN stats USING (user_id, kind) GROUP BY user_id, kind""",
)

_LOCATIONS = {
    "last_location_of_maximum": "(max(CASE WHEN x = hi THEN t END) + 1) / count(*)",
    "first_location_of_maximum": "min(CASE WHEN x = hi THEN t END) / count(*)",
    "last_location_of_minimum": "(max(CASE WHEN x = lo THEN t END) + 1) / count(*)",
    "first_location_of_minimum": "min(CASE WHEN x = lo THEN t END) / count(*)",
}
_register(
    "feat_locations",
    list(_LOCATIONS),
    f"WITH {STATS} SELECT user_id, kind, {_select(_LOCATIONS)} FROM long JOIN stats USING (user_id, kind) GROUP BY user_id, kind",
)

_register(
    "feat_strikes",
    ["longest_strike_below_mean", "longest_strike_above_mean"],
    f"""WITH {STATS}, sides AS (SELECT user_id, kind, t, sign(x - mu) AS side FROM long JOIN stats USING (user_id, kind)),
    numbered AS (SELECT *, t - row_number() OVER (PARTITION BY user_id, kind, side ORDER BY t) AS run FROM sides),
    runs AS (SELECT user_id, kind, side, run, count(*) AS length FROM numbered GROUP BY user_id, kind, side, run)
    SELECT user_id, kind, {_r("coalesce(max(length) FILTER (WHERE side = -1), 0)")} AS longest_strike_below_mean,
    {_r("coalesce(max(length) FILTER (WHERE side = 1), 0)")} AS longest_strike_above_mean
    FROM runs GROUP BY user_id, kind""",
)

_COUNTS = {
    "count_above_mean": "count(*) FILTER (WHERE x > mu)",
    "count_below_mean": "count(*) FILTER (WHERE x < mu)",
    **{
        f"ratio_beyond_r_sigma__r_{m}": f"count(*) FILTER (WHERE abs(x - mu) > {m} * sd) / count(*)"
        for m in X.SIGMA_MULTIPLES
    },
    f"count_above__t_{X.HIGH_LEVEL}": f"count(*) FILTER (WHERE x >= {X.HIGH_LEVEL}) / count(*)",
    f"count_below__t_{X.LOW_LEVEL}": f"count(*) FILTER (WHERE x <= {X.LOW_LEVEL}) / count(*)",
}
_register(
    "feat_counts",
    list(_COUNTS),
    f"""WITH {STATS}, sds AS (SELECT user_id, kind, sqrt(sum((x - mu) * (x - mu)) / count(*)) AS sd
      FROM long JOIN stats USING (user_id, kind) GROUP BY user_id, kind)
    SELECT user_id, kind, {", ".join(f"{_r(e)} AS {X.plain_name(n)}" for n, e in _COUNTS.items())}
    FROM long JOIN stats USING (user_id, kind) JOIN sds USING (user_id, kind) GROUP BY user_id, kind""",
)

_register(
    "feat_quantiles",
    ["median", *[f"quantile__q_{q}" for q in X.QUANTILES]],
    f"""WITH {LONG} SELECT user_id, kind, {_r("quantile_cont(x, 0.5)")} AS median,
    {", ".join(f"{_r(f'quantile_cont(x, {q})')} AS {X.plain_name(f'quantile__q_{q}')}" for q in X.QUANTILES)}
    FROM long GROUP BY user_id, kind""",
)

_CORRIDORS = [f"change_quantiles__f_agg_mean__isabs_true__qh_{b}__ql_{a}" for a, b in X.CHANGE_CORRIDORS]


def _corridor_sql(a: float, b: float) -> str:
    lo, hi = f"q{int(a * 10)}", f"q{int(b * 10)}"
    return f"""CASE WHEN max({lo}) = max({hi}) THEN 0 ELSE coalesce(avg(abs(x - before))
      FILTER (WHERE x BETWEEN {lo} AND {hi} AND before BETWEEN {lo} AND {hi}), 0) END"""


_register(
    "feat_change_quantiles",
    _CORRIDORS,
    f"""WITH {LONG}, edges AS (SELECT user_id, kind, quantile_cont(x, 0.6) AS q6, quantile_cont(x, 0.8) AS q8, max(x) AS q10
      FROM long GROUP BY user_id, kind),
    pairs AS (SELECT user_id, kind, x, lag(x) OVER (PARTITION BY user_id, kind ORDER BY t) AS before FROM long)
    SELECT user_id, kind, {", ".join(
        f"{_r(_corridor_sql(a, b))} AS {X.plain_name(n)}" for n, (a, b) in zip(_CORRIDORS, X.CHANGE_CORRIDORS))}
    FROM pairs JOIN edges USING (user_id, kind) GROUP BY user_id, kind""",
)

_register(
    "feat_trend",
    ["linear_trend__attr_slope"],
    f"WITH {LONG} SELECT user_id, kind, {_r('regr_slope(x, t)')} AS linear_trend__attr_slope FROM long GROUP BY user_id, kind",
)

_CHUNKS = [f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}" for i in range(10)]
_register(
    "feat_energy_chunks",
    _CHUNKS,
    f"""WITH {STATS}, cut AS (SELECT user_id, kind, x, CASE WHEN t < (n // 10 + 1) * (n % 10) THEN t // (n // 10 + 1)
      ELSE n % 10 + (t - (n // 10 + 1) * (n % 10)) // (n // 10) END AS chunk FROM long JOIN stats USING (user_id, kind))
    SELECT user_id, kind, {", ".join(
        f"{_r(f'CASE WHEN sum(x * x) <> 0 THEN coalesce(sum(x * x) FILTER (WHERE chunk = {i}), 0) / sum(x * x) END')} AS {c}"
        for i, c in enumerate(_CHUNKS))}
    FROM cut GROUP BY user_id, kind""",
)


def _peak_sql(n: int) -> str:
    over = "OVER (PARTITION BY user_id, kind ORDER BY t ROWS BETWEEN"
    return f"""t >= {n} AND t < n - {n} AND x > max(x) {over} {n} PRECEDING AND 1 PRECEDING)
      AND x > max(x) {over} 1 FOLLOWING AND {n} FOLLOWING) AS p{n}"""


_register(
    "feat_peaks",
    [f"number_peaks__n_{k}" for k in X.PEAK_SUPPORTS],
    f"""WITH {STATS}, marks AS (SELECT user_id, kind, {", ".join(_peak_sql(k) for k in X.PEAK_SUPPORTS)}
      FROM long JOIN stats USING (user_id, kind))
    SELECT user_id, kind, {", ".join(f"{_r(f'count(*) FILTER (WHERE p{k})')} AS number_peaks__n_{k}" for k in X.PEAK_SUPPORTS)}
    FROM marks GROUP BY user_id, kind""",
)

_register(
    "feat_topn",
    ["mean_n_absolute_max__number_of_maxima_10"],
    f"""WITH {LONG}, ranked AS (SELECT user_id, kind, abs(x) AS a,
      row_number() OVER (PARTITION BY user_id, kind ORDER BY abs(x) DESC) AS place, count(*) OVER (PARTITION BY user_id, kind) AS n FROM long)
    SELECT user_id, kind, {_r("CASE WHEN max(n) > 10 THEN sum(a) FILTER (WHERE place <= 10) / 10 END")}
      AS mean_n_absolute_max__number_of_maxima_10 FROM ranked GROUP BY user_id, kind""",
)

_register(
    "feat_permutation_entropy",
    ["permutation_entropy__dimension_7__tau_1"],
    f"""WITH {LONG}, wins AS (SELECT user_id, kind, t, list({{'v': x, 'i': t}})
        OVER (PARTITION BY user_id, kind ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS w FROM long),
    pats AS (SELECT user_id, kind, list_transform(list_sort(w), lambda e: e.i - t)::VARCHAR AS p FROM wins WHERE len(w) = 7),
    freq AS (SELECT user_id, kind, p, count(*) AS c FROM pats GROUP BY user_id, kind, p),
    tot AS (SELECT user_id, kind, sum(c) AS n FROM freq GROUP BY user_id, kind)
    SELECT user_id, kind, {_r("-sum(c / n * ln(c / n))")} AS permutation_entropy__dimension_7__tau_1
    FROM freq JOIN tot USING (user_id, kind) GROUP BY user_id, kind""",
)


def _abridged_sql() -> str:
    columns = []
    for c in SERIES:
        for end, cond in (("", "TRUE"), (f"_{TAIL}_day", f"t >= n - {TAIL}")):
            rows = f"FILTER (WHERE kind = '{c}' AND {cond})"
            columns.append(f"{_r(f'avg(x) {rows}')} AS {c}__mean{end}")
            columns.append(f"{_r(f'var_pop(x) {rows}')} AS {c}__variance{end}")
    return f"WITH {STATS} SELECT user_id, {', '.join(columns)} FROM long JOIN stats USING (user_id, kind) GROUP BY user_id"


@query("feat_abridged", _abridged_sql())
def feat_abridged(spark: SparkSession, where: str) -> DataFrame:
    return rounded(X.abridged_features(event_panel(spark, where), "user_id", SERIES, TAIL), DIGITS)


def _all_sql() -> str:
    """All parts side by side; a feature that two parts share is taken from the first."""
    seen: set[str] = set()
    joined = ""
    for features, sql in _PARTS:
        fresh = [X.plain_name(f) for f in features if f not in seen]
        seen.update(features)
        part = f"(SELECT user_id, kind, {', '.join(fresh)} FROM ({sql}))"
        joined += f" JOIN {part} USING (user_id, kind)" if joined else f"SELECT * FROM {part}"
    return joined


@query("feat_all_71", _all_sql())
def feat_all(spark: SparkSession, where: str) -> DataFrame:
    return _features(spark, where, X.ALL_FEATURES)


def _wide_sql() -> str:
    columns = [
        f"max(CASE WHEN kind = '{c}' THEN {X.plain_name(f)} END) AS {X.feature_name(c, f)}" for c in SERIES for f in X.ALL_FEATURES
    ]
    return f"SELECT user_id, {', '.join(columns)} FROM ({_all_sql()}) GROUP BY user_id"


@query("feat_wide", _wide_sql())
def feat_wide(spark: SparkSession, where: str) -> DataFrame:
    """All features of all series."""
    return X.pivot_features(_features(spark, where, X.ALL_FEATURES), "user_id", SERIES)
