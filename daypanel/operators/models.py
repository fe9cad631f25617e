"""Classifier fits, searches and scoring with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.operators.ordered import hashed_row_numbers
from daypanel.sources.tables import written

#: Rows of a partition that models are fitted on.
PARTITION_ROWS = 32_768


def dealt(df: DataFrame, cols: Sequence[str], per: int = PARTITION_ROWS, readers: int = 1) -> DataFrame:
    """The rows kept for fits, in a partition for every `per` of them and in an order by a hash of `cols`.

    A fit runs a job or more per step, with a task per partition: in the partitions
    of a shuffle, whose number is a setting, the tasks cost more than their rows.
    Draws by row and partition repeat. Tasks run where their partition is kept, so
    few partitions are kept in several copies for `readers` fits side by side.
    """
    stored = written(df.withColumn("_place", F.xxhash64(*[F.col(f"`{c}`") for c in cols])))
    parts = max(1, math.ceil(stored.count() / per))
    placed = stored.repartition(parts, "_place").sortWithinPartitions("_place").drop("_place")
    return placed.persist(StorageLevel(True, True, False, True, max(1, math.ceil(readers / parts))))


def logistic_pipeline(label: str, cols: Sequence[str], weight: str | None = None, **params) -> Pipeline:
    """Assembler and a binomial/logit linear model (IRLS, L2 through `regParam`)."""
    glm = GeneralizedLinearRegression(
        labelCol=label, featuresCol="features", family="binomial", link="logit", maxIter=params.pop("maxIter", 1000), **params
    )
    if weight:
        glm = glm.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), glm])


def fit_logistic(df: DataFrame, label: str, cols: Sequence[str], weight: str | None = None, **params) -> PipelineModel:
    return logistic_pipeline(label, cols, weight, **params).fit(df)


def coefficient_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, log_odds, probability, p_value, standard_error), one row per feature."""
    names = model.stages[0].getInputCols()
    glm = model.stages[-1]
    summary = glm.summary
    rows = [
        (name, float(c), 1.0 / (1.0 + math.exp(-c)), float(p), float(s))
        for name, c, p, s in zip(names, glm.coefficients, summary.pValues, summary.coefficientStandardErrors)
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature string, log_odds double, probability double, p_value double, standard_error double"
    ).orderBy("p_value")


def fit_summary(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row: intercept as log odds and probability, and AIC."""
    glm = model.stages[-1]
    row = [(float(glm.intercept), 1.0 / (1.0 + math.exp(-glm.intercept)), float(glm.summary.aic))]
    return df.sparkSession.createDataFrame(row, "intercept_log_odds double, intercept_probability double, aic double")


def pr_evaluator(label: str, score: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderPR")


def cross_validate(
    pipeline: Pipeline,
    df: DataFrame,
    label: str,
    score: str,
    folds: int = 5,
    seed: int | None = None,
    fold_col: str | None = None,
    grid: Sequence | None = None,
    parallelism: int = 1,
):
    """Cross-validated fit by PR area; `fold_col` fixes the folds."""
    validator = CrossValidator(
        estimator=pipeline,
        evaluator=pr_evaluator(label, score),
        estimatorParamMaps=list(grid) if grid else ParamGridBuilder().build(),
        numFolds=folds,
        parallelism=parallelism,
    )
    if seed is not None:
        validator = validator.setSeed(seed)
    if fold_col:
        validator = validator.setFoldCol(fold_col)
    return validator.fit(df)


def add_folds(df: DataFrame, id: str, label: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Stratified folds: each label's rows are dealt out in hashed order, one fold after another."""
    numbered = hashed_row_numbers(df, id, seed, by=[label], out="_rn")
    return numbered.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")


def best_fold_model(pipeline: Pipeline, df: DataFrame, label: str, score: str, fold_col: str, k: int):
    """Fit on all folds but one in turn; keep the model that scores best on the fold left out."""
    evaluator = pr_evaluator(label, score)
    best, best_value = None, -1.0
    for fold in range(k):
        model = pipeline.fit(df.where(F.col(fold_col) != fold))
        value = evaluator.evaluate(model.transform(df.where(F.col(fold_col) == fold)))
        if value > best_value:
            best, best_value = model, value
    return best, best_value


def uniform(lo: float, hi: float, step: float | None = None) -> Callable[[random.Random], float]:
    """Uniform draw; with `step` rounded to a multiple of it, but kept in [lo, hi]."""

    def draw(rng: random.Random) -> float:
        value = rng.uniform(lo, hi)
        return min(hi, max(lo, round(value / step) * step)) if step else value

    return draw


def log_uniform(lo: float, hi: float) -> Callable[[random.Random], float]:
    """e to a uniform draw from [lo, hi]."""
    return lambda rng: math.exp(rng.uniform(lo, hi))


def choice(options: Sequence) -> Callable[[random.Random], object]:
    return lambda rng: rng.choice(list(options))


def drawn_trials(space: Mapping[str, Callable[[random.Random], object]], trials: int, seed: int) -> list[dict]:
    """The parameters of the trials of a seeded search."""
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(trials)]


def random_search(
    fit: Callable[[dict], tuple[float, object]],
    space: Mapping[str, Callable[[random.Random], object]],
    trials: int,
    seed: int,
    spark,
) -> tuple[DataFrame, dict, object]:
    """Seeded random search; `fit` trains on Spark and returns (score to maximise, model).

    Gives the trials table, the best parameters and the best model.
    """
    rows, best = [], None
    for number, params in enumerate(drawn_trials(space, trials, seed)):
        score, model = fit(params)
        rows.append((number, float(score), {k: str(v) for k, v in params.items()}))
        if best is None or score > best[0]:
            best = (score, params, model)
    table = spark.createDataFrame(rows, "trial int, score double, params map<string,string>")
    return table, best[1], best[2]


def fit_gbt(
    df: DataFrame, label: str, cols: Sequence[str], weight: str | None = None, subsample: float = 0.5, seed: int = 0, **params
) -> PipelineModel:
    """Boosted trees; `maxDepth`, `stepSize`, `minInfoGain` and `maxIter` pass through."""
    trees = GBTClassifier(labelCol=label, featuresCol="features", subsamplingRate=subsample, seed=seed, **params)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), trees]).fit(df)


def positive_weight(df: DataFrame, label: str, scale: float, out: str = "weight") -> DataFrame:
    """Weight `scale` for positives and 1 for the rest."""
    return df.withColumn(out, F.when(F.col(label) == 1, float(scale)).otherwise(1.0))


def importances(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """(feature, importance) of the `top` features with the largest importance."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def fit_mlp(df: DataFrame, label: str, cols: Sequence[str], hidden: Sequence[int], seed: int = 0, **params) -> PipelineModel:
    """Feed-forward classifier with the given hidden layer sizes and two outputs."""
    net = MultilayerPerceptronClassifier(
        labelCol=label, featuresCol="features", layers=[len(cols), *hidden, 2], seed=seed, **params
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), net]).fit(df)


def with_probability(scored: DataFrame, out: str = "score") -> DataFrame:
    """The probability of class 1 as a plain double column."""
    return scored.withColumn(out, vector_to_array("probability")[1])


def hidden_representation(model: PipelineModel, df: DataFrame, keep: Sequence[str], out: str = "hidden") -> DataFrame:
    """Values of the last hidden layer per row, as an array column.

    The weights (a few numbers per connection) travel with the task; rows are
    processed where they are, in Arrow batches.
    """
    names = list(model.stages[0].getInputCols())
    net = model.stages[-1]
    layers, flat = list(net.getLayers()), net.weights.toArray()
    weights, start = [], 0
    for fan_in, fan_out in zip(layers, layers[1:]):
        matrix = flat[start : start + fan_in * fan_out].reshape(fan_in, fan_out)
        start += fan_in * fan_out
        weights.append((matrix, flat[start : start + fan_out]))
        start += fan_out
    hidden_layers = weights[:-1]

    def forward(batches):
        for batch in batches:
            values = batch[names].to_numpy(dtype=float)
            for matrix, bias in hidden_layers:
                values = 1.0 / (1.0 + np.exp(-(values @ matrix + bias)))
            yield pd.DataFrame({**{k: batch[k] for k in keep}, out: list(values)})

    source = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names if c not in keep])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)
    return source.mapInPandas(forward, f"{kept}, {out} array<double>")
