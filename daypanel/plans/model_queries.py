"""Model fits on the per-user feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.operators import boosting
from daypanel.operators import models as M
from daypanel.operators.evaluation import curve_areas
from daypanel.operators.resample import class_weights, upsample
from daypanel.plans.newton_sql import curve_steps, dealt_folds, log_odds, logistic_fit, normal_two_sided
from daypanel.plans.registry import query, rounded
from daypanel.plans.selection_queries import EVENT_SERIES, MATRIX, matrix
from daypanel.sources.spine import TWO_WAY_SPLIT, split_by_mod
from daypanel.sources.tables import written

# TS_ALL is the sum of the counts, so it is left out of the linear model.
COLS = [*EVENT_SERIES, "TS_UNITS", "TS_TOP"]
# Full fits as published: 50 epochs of these layers; 100 rounds of depth 6 are the boosting library's defaults.
LAYERS, EPOCHS, ROUNDS, DEPTH = (128, 128, 128, 64, 32, 16, 3), 50, 100, 6
# A net's step costs far more per row than that of a tree or a linear model.
NET_ROWS = 8_192


def _halves(spark: SparkSession, where: str, per: int = M.PARTITION_ROWS) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, made once; train is kept, in few partitions, while a model is fitted on it."""
    rows = matrix(spark, where).select("user_id", F.col("target").cast("double").alias("labels"), *COLS)
    parts = written(split_by_mod(rows, "user_id", bounds=TWO_WAY_SPLIT))
    return M.dealt(parts.where("split = 'train'"), ["user_id"], per), parts.where("split = 'test'")


def _sorted_json(params: str):
    """A map as JSON, its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


_DATA = f"WITH RECURSIVE {MATRIX}, data AS (SELECT *, target AS labels, user_id % 20 < 14 AS train FROM matrix)"
_WEIGHTS = """share AS (SELECT count(*) FILTER (WHERE labels <> 1) / count(*) AS s FROM data WHERE train),
weighted AS (SELECT 0 AS fit, labels AS y, CASE WHEN labels = 1 THEN s ELSE 1 - s END AS weight, data.* FROM data, share WHERE train)"""


@query(
    "logistic_weighted",
    f"""{_DATA}, {_WEIGHTS}, {logistic_fit("weighted", COLS, 0.02, 5.5e-7)}
    SELECT user_id, CAST(labels AS DOUBLE) AS labels, round(1 / (1 + exp(-({log_odds("coef", COLS, "data")}))), 6) + 0.0 AS score
    FROM data, fitted WHERE NOT train""",
)
def logistic_weighted(spark: SparkSession, where: str) -> DataFrame:
    train, test = _halves(spark, where)
    model = M.fit_logistic(class_weights(train, "labels"), "labels", COLS, "classWeightCol", regParam=0.02, tol=5.5e-7)
    train.unpersist()
    return rounded(model.transform(test).select("user_id", "labels", F.col("prediction").alias("score")))


@query(
    "logistic_coefficients",
    f"""{_DATA}, {_WEIGHTS}, {logistic_fit("weighted", COLS, 0.02)},
    each AS (SELECT unnest([{", ".join(f"'{c}'" for c in COLS)}]) AS feature, unnest(coef[1:{len(COLS)}]) AS b, unnest(error[1:{len(COLS)}]) AS e FROM fitted)
    SELECT feature, round(b, 6) + 0.0 AS log_odds, round(1 / (1 + exp(-b)), 6) + 0.0 AS probability,
      round({normal_two_sided("(b / e)")}, 6) + 0.0 AS p_value, round(e, 6) + 0.0 AS standard_error FROM each""",
)
def logistic_coefficients(spark: SparkSession, where: str) -> DataFrame:
    train, _ = _halves(spark, where)
    weighted = class_weights(train, "labels")
    model = M.fit_logistic(weighted, "labels", COLS, "classWeightCol", regParam=0.02)
    train.unpersist()
    return rounded(M.coefficient_table(model, weighted))


@query(
    "logistic_summary",
    f"""{_DATA}, plain AS (SELECT 0 AS fit, labels AS y, 1.0::DOUBLE AS weight, * FROM data WHERE train), {logistic_fit("plain", COLS, 0.02)},
    likely AS (SELECT sum(CASE WHEN y = 1 THEN ln(mu) ELSE ln(1 - mu) END) AS l FROM (
      SELECT y, 1 / (1 + exp(-({log_odds("coef", COLS, "plain")}))) AS mu FROM plain, fitted))
    SELECT round(coef[{len(COLS) + 1}], 6) + 0.0 AS intercept_log_odds, round(1 / (1 + exp(-coef[{len(COLS) + 1}])), 6) + 0.0 AS intercept_probability,
      round(2 * {len(COLS) + 1} - 2 * l, 6) + 0.0 AS aic FROM fitted, likely""",
)
def logistic_summary(spark: SparkSession, where: str) -> DataFrame:
    train, _ = _halves(spark, where)
    summary = M.fit_summary(M.fit_logistic(train, "labels", COLS, regParam=0.02), train)
    train.unpersist()
    return rounded(summary)


_SCORE = f"1 / (1 + exp(-({log_odds('f.coef', COLS, 'd')})))"


@query(
    "logistic_cross_validated",
    f"""{_DATA}, folded AS MATERIALIZED {dealt_folds("(SELECT * FROM data WHERE train)", "user_id", "labels", 5, 42)},
    parts AS (SELECT f.fit, d.labels AS y, 1.0::DOUBLE AS weight, d.* FROM folded d, (SELECT unnest(range(6)) AS fit) f WHERE d.fold <> f.fit),
    {logistic_fit("parts", COLS, 0.02)},
    held AS (SELECT f.fit, d.labels AS y, {_SCORE} AS score FROM folded d JOIN fitted f ON f.fit = d.fold),
    tested AS (SELECT f.fit, d.labels AS y, {_SCORE} AS score FROM data d JOIN fitted f ON f.fit = 5 WHERE NOT d.train),
    {curve_steps("held", "held_steps")}, {curve_steps("tested", "steps")},
    each AS (SELECT fit, sum((y - y0) * (prec + prec0) / 2) AS area FROM held_steps GROUP BY fit)
    SELECT round(sum((x - x0) * (y + y0) / 2), 6) + 0.0 AS roc_auc, round(sum((y - y0) * (prec + prec0) / 2), 6) + 0.0 AS pr_auc,
      round(sum((y - y0) * prec), 6) + 0.0 AS average_precision, (SELECT round(avg(area), 6) + 0.0 FROM each) AS cv_pr_auc FROM steps""",
)
def logistic_cross_validated(spark: SparkSession, where: str) -> DataFrame:
    train, test = _halves(spark, where)
    pipeline = M.logistic_pipeline("labels", COLS, regParam=0.02)
    # Every step of the last fit reads all folds.
    folded = M.dealt(M.add_folds(train, "user_id", "labels", 5, seed=42), ["user_id"])
    fitted = M.cross_validate(pipeline, folded, "labels", "prediction", folds=5, fold_col="fold")
    folded.unpersist()
    train.unpersist()
    scored = fitted.bestModel.transform(test).select("labels", "prediction")
    return rounded(curve_areas(scored, "labels", "prediction").withColumn("cv_pr_auc", F.lit(float(fitted.avgMetrics[0]))))


_SPACE = {"regParam": M.uniform(0.01, 0.5, 0.05), "tol": M.uniform(1e-8, 1e-6, 5e-7)}
_DRAWN = M.drawn_trials(_SPACE, 20, 42)
_TRIALS = ", ".join(f"""({i}, {p["regParam"]!r}::DOUBLE, {p["tol"]!r}::DOUBLE, '{{"regParam":"{p["regParam"]}","tol":"{p["tol"]}"}}')""" for i, p in enumerate(_DRAWN))


@query(
    "random_search",
    f"""{_DATA}, fits(fit, ridge, tol, params) AS (VALUES {_TRIALS}),
    parts AS (SELECT f.fit, f.ridge, f.tol, d.labels AS y, 1.0::DOUBLE AS weight, d.* FROM data d, fits f WHERE d.train),
    {logistic_fit("parts", COLS, None, None)},
    held AS (SELECT f.fit, d.labels AS y, {_SCORE} AS score FROM data d, fitted f WHERE d.user_id % 20 BETWEEN 14 AND 17), {curve_steps("held", "steps")}
    SELECT CAST(fit AS INTEGER) AS trial, round(sum((y - y0) * (prec + prec0) / 2), 6) + 0.0 AS score, params
    FROM steps JOIN fits USING (fit) GROUP BY fit, params""",
)
def random_search(spark: SparkSession, where: str, trials: int = 20) -> DataFrame:
    """Trials of the linear model, scored on validation rows that neither the fits nor a test see."""
    rows = matrix(spark, where).select("user_id", F.col("target").cast("double").alias("labels"), *COLS)
    parts = M.dealt(split_by_mod(rows, "user_id").where("split <> 'test'"), ["user_id"])
    train, validation = parts.where("split = 'train'"), parts.where("split = 'val'")
    evaluator = M.pr_evaluator("labels", "prediction")

    def fit(params: dict):
        model = M.fit_logistic(train, "labels", COLS, **params)
        return evaluator.evaluate(model.transform(validation)), model

    table, _, _ = M.random_search(fit, _SPACE, trials, 42, spark)
    parts.unpersist()
    return rounded(table.select("trial", "score", _sorted_json("params").alias("params")))


@query("gbt_scores")
def gbt_scores(spark: SparkSession, where: str, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    train, test = _halves(spark, where)
    weighted = M.positive_weight(train, "labels", 3.0)
    model = M.fit_gbt(weighted, "labels", COLS, "weight", maxDepth=depth, stepSize=0.1, minInfoGain=0.0, maxIter=rounds, seed=11)
    train.unpersist()
    return rounded(M.with_probability(model.transform(test)).select("user_id", "labels", "score"))


@query("gbt_importance")
def gbt_importance(spark: SparkSession, where: str, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    train, _ = _halves(spark, where)
    model = M.fit_gbt(train, "labels", COLS, maxDepth=depth, maxIter=rounds, seed=11)
    train.unpersist()
    return rounded(M.importances(model, train, top=20))


@query("gbt_split_importance")
def gbt_split_importance(spark: SparkSession, where: str, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    """How often, on how many rows and to what gain the boosted trees split on each column."""
    train, _ = _halves(spark, where)
    model = M.fit_gbt(train, "labels", COLS, maxDepth=depth, maxIter=rounds, seed=11)
    found = boosting.split_importance(model, train, top=20)
    return rounded(found)


@query("gbt_search")
def gbt_search(spark: SparkSession, where: str, trials: int = boosting.TRIALS, rounds: int = boosting.ROUNDS) -> DataFrame:
    """All fits of a search over boosted trees, scored on validation rows that neither the fits nor a test see."""
    rows = matrix(spark, where).select("user_id", F.col("target").cast("double").alias("labels"), *COLS)
    parts = split_by_mod(rows, "user_id")
    table, _, _ = boosting.search_trees(
        parts.where("split = 'train'"), parts.where("split = 'val'"), "labels", COLS, trials, seed=4231, rounds=rounds
    )
    return rounded(table.select("trial", "rung", "rounds", "score", _sorted_json("params").alias("params")))


@query(
    "best_fold_model",
    f"""{_DATA}, folded AS MATERIALIZED {dealt_folds("(SELECT * FROM data WHERE train)", "user_id", "labels", 3, 2134)},
    parts AS (SELECT f.fit, d.labels AS y, 1.0::DOUBLE AS weight, d.* FROM folded d, (SELECT unnest(range(3)) AS fit) f WHERE d.fold <> f.fit),
    {logistic_fit("parts", COLS, 0.05)},
    held AS (SELECT f.fit, d.labels AS y, {_SCORE} AS score FROM folded d JOIN fitted f ON f.fit = d.fold), {curve_steps("held", "steps")},
    each AS (SELECT fit, sum((y - y0) * (prec + prec0) / 2) AS area FROM steps GROUP BY fit),
    best AS (SELECT fit, area FROM each ORDER BY area DESC, fit LIMIT 1)
    SELECT d.user_id, CAST(d.labels AS DOUBLE) AS labels, round({_SCORE}, 6) + 0.0 AS score, round(b.area, 6) + 0.0 AS fold_pr_auc
    FROM data d, best b JOIN fitted f ON f.fit = b.fit WHERE NOT d.train""",
)
def best_fold_model(spark: SparkSession, where: str) -> DataFrame:
    train, test = _halves(spark, where)
    folded = M.dealt(M.add_folds(train, "user_id", "labels", 3, seed=2134), ["user_id"])
    pipeline = M.logistic_pipeline("labels", COLS, regParam=0.05)
    model, value = M.best_fold_model(pipeline, folded, "labels", "prediction", "fold", 3)
    folded.unpersist()
    train.unpersist()
    scored = model.transform(test).select("user_id", "labels", F.col("prediction").alias("score"))
    return rounded(scored.withColumn("fold_pr_auc", F.lit(float(value))))


@query("mlp_scores")
def mlp_scores(spark: SparkSession, where: str, layers: Sequence[int] = LAYERS, iterations: int = EPOCHS) -> DataFrame:
    train, test = _halves(spark, where, NET_ROWS)
    model = M.fit_mlp(upsample(train, "labels"), "labels", COLS, layers, seed=5, maxIter=iterations)
    train.unpersist()
    return rounded(M.with_probability(model.transform(test)).select("user_id", "labels", "score"))


@query("hidden_representation")
def hidden_representation(spark: SparkSession, where: str, layers: Sequence[int] = LAYERS, iterations: int = EPOCHS) -> DataFrame:
    train, test = _halves(spark, where, NET_ROWS)
    model = M.fit_mlp(train, "labels", COLS, layers, seed=5, maxIter=iterations)
    train.unpersist()
    hidden = M.hidden_representation(model, test, ["user_id", "labels"])
    return rounded(hidden.select("user_id", "labels", *[F.get("hidden", F.lit(i)).alias(f"h{i}") for i in range(layers[-1])]))
