"""Null and variance scans, ANOVA and correlation pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.columns import yes
from daypanel.operators import selection as S
from daypanel.operators.features import abridged_features
from daypanel.plans.registry import query, rounded
from daypanel.plans.standins import END, EVENT_SERIES, LONG, SERIES, START, TAIL, TARGETS, event_panel, events, targets
from daypanel.sources.spine import day_count
from daypanel.sources.tables import load

COLS = [*EVENT_SERIES, "TS_UNITS", "TS_MEAN", "TS_TOP", "TS_ALL", "TS_ZERO", "TS_HOLES"]
USABLE = [c for c in COLS if c not in ("TS_ZERO", "TS_HOLES")]
MATRIX = f"""{TARGETS}, matrix AS (SELECT user_id, target,
  {", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{v}') AS DOUBLE) AS {k}" for k, v in EVENT_SERIES.items())},
  sum(floor(value)) AS TS_UNITS, sum(floor(value)) / count(*) AS TS_MEAN, max(value) AS TS_TOP,
  CAST(count(*) AS DOUBLE) AS TS_ALL, 0.0::DOUBLE AS TS_ZERO,
  CASE WHEN user_id % 9 <> 0 THEN CAST(count(*) AS DOUBLE) END AS TS_HOLES
  FROM events JOIN targets USING (user_id) GROUP BY user_id, target)"""


def _unnested(cols: list[str]) -> str:
    names, values = ", ".join(f"'{c}'" for c in cols), ", ".join(cols)
    return f"long AS (SELECT user_id, target, unnest([{names}]) AS feature, unnest([{values}]) AS x FROM matrix)"


TESTS = f"""{MATRIX}, {_unnested(USABLE)},
parts AS (SELECT feature, target, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM long GROUP BY feature, target),
grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM parts GROUP BY feature),
tests AS (SELECT feature, sum(n * (m - g) * (m - g)) AS ss_target, sum((n - 1) * v) AS ss_residual,
  CAST(count(*) - 1 AS DOUBLE) AS df_target, CAST(sum(n) - count(*) AS DOUBLE) AS df_residual
  FROM parts JOIN grand USING (feature) GROUP BY feature)"""

# With two groups F is the square of a t, whose tail is an integral of a power of the cosine: Simpson's rule over 2,000 steps.
P_VALUES = f"""{TESTS},
fs AS (SELECT *, (ss_target / df_target) / (ss_residual / df_residual) AS F FROM tests),
angles AS (SELECT *, atan(sqrt(F / df_residual)) AS a, pi() / 2 AS b FROM fs),
nodes AS (SELECT i / 2000 AS part, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 2001) t(i)),
tails AS (SELECT feature, (b - a) * sum(w * pow(cos(a + (b - a) * part), df_residual - 1)) / (b * sum(w * pow(cos(b * part), df_residual - 1))) AS p_value
  FROM angles, nodes GROUP BY feature, a, b),
tested AS (SELECT * FROM fs JOIN tails USING (feature))"""


def matrix(spark: SparkSession, where: str) -> DataFrame:
    """One row per user: counts, totals, a constant column and a column with nulls."""
    counts = [F.sum(yes(F.col("event_type") == v)).cast("double").alias(k) for k, v in EVENT_SERIES.items()]
    units = F.sum(F.floor("value")).cast("double")
    made = events(spark, where).groupBy("user_id").agg(
        *counts,
        units.alias("TS_UNITS"),
        (units / F.count("*")).alias("TS_MEAN"),
        F.max("value").alias("TS_TOP"),
        F.count("*").cast("double").alias("TS_ALL"),
        F.lit(0.0).alias("TS_ZERO"),
        F.when(F.col("user_id") % 9 != 0, F.count("*").cast("double")).alias("TS_HOLES"),
    )
    return made.join(targets(spark, where), "user_id")


@query(
    "null_report",
    f"""WITH {MATRIX}, {_unnested(COLS)} SELECT feature AS column_name,
    round(count(*) FILTER (WHERE x IS NULL) / count(*), 6) + 0.0 AS percent_null, count(*) FILTER (WHERE x IS NULL) AS number_null
    FROM long GROUP BY feature""",
)
def null_report(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.null_report(matrix(spark, where), COLS))


@query(
    "zero_variance_scan",
    f"""WITH {MATRIX}, {_unnested(COLS)} SELECT feature, round(var_samp(x), 4) + 0.0 AS variance,
    count(*) FILTER (WHERE x IS NULL) AS number_null FROM long GROUP BY feature""",
)
def zero_variance_scan(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.column_spread(matrix(spark, where), COLS), 4)


@query(
    "usable_columns",
    f"""WITH {MATRIX} SELECT user_id, target, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in USABLE)} FROM matrix""",
)
def usable_columns(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.drop_constant_or_null(matrix(spark, where), COLS))


_ANOVA_COLUMNS = """feature, round(ss_target, 4) + 0.0 AS ss_target, round(ss_residual, 4) + 0.0 AS ss_residual,
    df_target, df_residual, round(F, 4) + 0.0 AS F, round(p_value, 4) + 0.0 AS p_value"""


@query("anova_f", f"WITH {P_VALUES} SELECT {_ANOVA_COLUMNS} FROM tested")
def anova_f(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.anova(matrix(spark, where), USABLE, "target"), 4)


@query(
    "anova_table",
    f"""WITH {P_VALUES} SELECT feature, 'target' AS level, round(ss_target, 4) + 0.0 AS sum_sq, df_target AS df,
      round(F, 4) + 0.0 AS F, round(p_value, 4) + 0.0 AS p_value FROM tested
    UNION ALL SELECT feature, 'Residual', round(ss_residual, 4) + 0.0, df_residual, NULL, NULL FROM tested""",
)
def anova_table(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.anova_table(S.anova(matrix(spark, where), USABLE, "target")), 4)


@query(
    "anova_on_lines",
    """WITH parts AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
    g AS (SELECT sum(n * m) / sum(n) AS g FROM parts)
    SELECT 'l_extendedprice' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 4) + 0.0 AS F
    FROM parts, g""",
)
def anova_on_lines(spark: SparkSession, where: str) -> DataFrame:
    tests = S.anova(load(spark, where, "lineitem"), ["l_extendedprice"], "l_returnflag")
    return rounded(tests.select("feature", "F"), 4)


@query("anova_select", f"WITH {P_VALUES} SELECT {_ANOVA_COLUMNS} FROM tested WHERE p_value <= 0.05")
def anova_select(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.passing(S.anova(matrix(spark, where), USABLE, "target"), alpha=0.05), 4)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS index, '{b}' AS variable, corr({a}, {b}) AS value FROM matrix" for a in USABLE for b in USABLE if a != b
)


@query("correlation_long", f"WITH {MATRIX}, pairs AS ({_PAIRS}) SELECT index, variable, round(value, 6) + 0.0 AS value FROM pairs")
def correlation_long(spark: SparkSession, where: str) -> DataFrame:
    return rounded(S.correlation_long(matrix(spark, where), USABLE))


_TILED = f"""{LONG}, wide AS (SELECT user_id, kind || '_' || t AS name, x FROM long),
pairs AS (SELECT a.name AS index, b.name AS variable, count(*) AS n, sum(a.x) AS a, sum(b.x) AS b,
  sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb, sum(a.x * b.x) AS ab
  FROM wide a JOIN wide b ON a.user_id = b.user_id AND a.name <> b.name GROUP BY 1, 2)"""


@query(
    "correlation_tiles",
    f"""WITH {_TILED} SELECT index, variable,
    round(CASE WHEN n * aa > a * a AND n * bb > b * b THEN (n * ab - a * b) / (sqrt(n * aa - a * a) * sqrt(n * bb - b * b)) END, 6) + 0.0 AS value FROM pairs""",
)
def correlation_tiles(spark: SparkSession, where: str) -> DataFrame:
    """Every measure of every day against every other, in tiles of 32 columns."""
    panel = event_panel(spark, where)
    wide = {f"{c}_{t}": F.get(c, F.lit(t)) for c in SERIES for t in range(day_count(START, END))}
    return rounded(S.correlation_long(panel.select(*[v.alias(k) for k, v in wide.items()]), list(wide), tile=32))


@query(
    "correlation_rank",
    f"""WITH {MATRIX}, pairs AS ({_PAIRS}) SELECT index, variable,
    CAST(row_number() OVER (PARTITION BY index ORDER BY abs(value) ASC NULLS LAST, variable) AS INTEGER) AS rank FROM pairs""",
)
def correlation_rank(spark: SparkSession, where: str) -> DataFrame:
    return S.rank_pairs(S.correlation_long(matrix(spark, where), USABLE)).drop("value")


@query(
    "correlation_prune",
    f"""WITH {TESTS}, fs AS (SELECT feature, (ss_target / df_target) / (ss_residual / df_residual) AS F FROM tests), pairs AS ({_PAIRS})
    SELECT DISTINCT index FROM pairs JOIN fs a ON a.feature = index JOIN fs b ON b.feature = variable WHERE value >= 0.5 AND a.F < b.F""",
)
def correlation_prune(spark: SparkSession, where: str) -> DataFrame:
    # With equal degrees of freedom a larger p is a smaller F, which the twin can compute; on many rows p is 0 for several.
    df = matrix(spark, where)
    return S.correlated_losers(S.correlation_long(df, USABLE), S.anova(df, USABLE, "target"), cutoff=0.5, break_ties=True)


_CHOSEN_COLS = [f"{c}__{stat}{end}" for c in SERIES for end in ("", f"_{TAIL}_day") for stat in ("mean", "variance")]
_FEATURES = ", ".join(
    f"avg(x) FILTER (WHERE kind = '{c}' AND {rows}) AS {c}__mean{end}, var_pop(x) FILTER (WHERE kind = '{c}' AND {rows}) AS {c}__variance{end}"
    for c in SERIES
    for end, rows in (("", "true"), (f"_{TAIL}_day", f"t >= {day_count(START, END) - TAIL}"))
)
# Every feature from its variance to its fate: what select_features does, in rows.
_SELECTION = f"""{LONG}, {TARGETS}, wide AS (SELECT user_id, {_FEATURES} FROM long GROUP BY user_id),
labelled AS (SELECT target, wide.* FROM wide JOIN targets USING (user_id)),
melted AS (SELECT user_id, target, unnest([{", ".join(f"'{c}'" for c in _CHOSEN_COLS)}]) AS feature, unnest([{", ".join(_CHOSEN_COLS)}]) AS x FROM labelled),
usable AS (SELECT feature FROM melted GROUP BY feature HAVING max(x) > min(x) AND count(*) = count(x)),
kept_long AS (SELECT * FROM melted SEMI JOIN usable USING (feature)),
parts AS (SELECT feature, target, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM kept_long GROUP BY feature, target),
grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM parts GROUP BY feature),
fs AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS F,
  CAST(sum(n) - count(*) AS DOUBLE) AS df_residual FROM parts JOIN grand USING (feature) GROUP BY feature),
angles AS (SELECT *, atan(sqrt(F / df_residual)) AS a, pi() / 2 AS b FROM fs),
nodes AS (SELECT i / 2000 AS part, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 2001) t(i)),
tested AS (SELECT feature, F, (b - a) * sum(w * pow(cos(a + (b - a) * part), df_residual - 1)) / (b * sum(w * pow(cos(b * part), df_residual - 1))) AS p
  FROM angles, nodes GROUP BY feature, F, a, b),
strong AS (SELECT * FROM tested WHERE p <= 0.3),
pairs AS (SELECT x.feature AS index, y.feature AS variable, corr(x.x, y.x) AS value
  FROM kept_long x JOIN kept_long y ON x.user_id = y.user_id AND x.feature <> y.feature
  WHERE x.feature IN (SELECT feature FROM strong) AND y.feature IN (SELECT feature FROM strong) GROUP BY 1, 2),
losers AS (SELECT DISTINCT index AS feature FROM pairs JOIN strong i ON i.feature = index JOIN strong v ON v.feature = variable WHERE value >= 0.8 AND i.p > v.p)"""


@query(
    "selected_features",
    f"""WITH {_SELECTION} SELECT feature, round(F, 4) + 0.0 AS F, round(p, 4) + 0.0 AS p_value,
      CASE WHEN feature IN (SELECT feature FROM losers) THEN 'correlated' WHEN p > 0.3 THEN 'weak' ELSE 'selected' END AS fate FROM tested""",
)
def selected_features(spark: SparkSession, where: str) -> DataFrame:
    """Every usable feature of the panel with its test and what the selection makes of it."""
    made = abridged_features(event_panel(spark, where), "user_id", SERIES, TAIL)
    wide = targets(spark, where).join(made, "user_id", "left")
    chosen, tests = S.select_features(wide, [c for c in made.columns if c != "user_id"], "target", alpha=0.3)
    fate = F.when(F.col("feature").isin(chosen), "selected").when(F.col("p_value") <= 0.3, "correlated").otherwise("weak")
    return rounded(tests.select("feature", "F", "p_value", fate.alias("fate")), 4)


@query("select_features")
def select_features(spark: SparkSession, where: str) -> DataFrame:
    """Abridged features of the panel through the whole selection, joined to static columns."""
    made = abridged_features(event_panel(spark, where), "user_id", SERIES, TAIL)
    static = targets(spark, where)
    wide = static.join(made, "user_id", "left")
    cols = [c for c in made.columns if c != "user_id"]
    chosen, _ = S.select_features(wide, cols, "target", alpha=0.3)
    return rounded(S.assemble_final(static, made, "user_id", chosen))
