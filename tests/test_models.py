"""Fits on separable data, folds, search and the hidden layer."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.operators import models as M
from daypanel.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        y = float(i % 3 == 0)
        rows.append((i, y, rng.gauss(2 * y, 1), rng.gauss(-1 * y, 1), rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, labels double, a double, b double, noise double").persist()


COLS = ["a", "b", "noise"]


def test_logistic_signs_and_tables(train):
    model = M.fit_logistic(train, "labels", COLS, regParam=0.01)
    table = {r["feature"]: r for r in M.coefficient_table(model, train).collect()}
    assert table["a"]["log_odds"] > 0 > table["b"]["log_odds"]
    assert table["a"]["p_value"] < 1e-6 < table["noise"]["p_value"]
    assert table["a"]["probability"] == pytest.approx(1 / (1 + math.exp(-table["a"]["log_odds"])))
    assert M.fit_summary(model, train).first()["aic"] > 0


def test_folds_are_stratified(train):
    folds = M.add_folds(train, "id", "labels", 5, seed=3).groupBy("labels").pivot("fold", list(range(5))).count().collect()
    assert {tuple(r[str(i)] for i in range(5)) for r in folds} == {(20,) * 5, (40,) * 5}


def test_fixed_folds_cross_validation(train):
    folded = M.add_folds(train, "id", "labels", 3)
    fitted = M.cross_validate(
        M.logistic_pipeline("labels", COLS, regParam=0.02), folded, "labels", "prediction", folds=3, fold_col="fold"
    )
    assert 0.8 < fitted.avgMetrics[0] <= 1.0
    model, value = M.best_fold_model(M.logistic_pipeline("labels", COLS), folded, "labels", "prediction", "fold", 3)
    assert 0.8 < value <= 1.0 and model.stages[-1].coefficients[0] > 0


def test_random_search_is_seeded(spark):
    space = {"a": M.uniform(0.0, 1.0, 0.25), "b": M.log_uniform(-3, -1), "c": M.choice([[3], [4, 3]])}
    fit = lambda p: (-abs(p["a"] - 0.5) - p["b"], p)
    one, best, _ = M.random_search(fit, space, 12, 4, spark)
    two, again, _ = M.random_search(fit, space, 12, 4, spark)
    assert one.collect() == two.collect() and best == again
    assert one.agg(F.max("score")).first()[0] == pytest.approx(fit(best)[0])


def test_trees_rank_the_informative_columns(train):
    weighted = M.positive_weight(train, "labels", 2.0)
    model = M.fit_gbt(weighted, "labels", COLS, "weight", maxDepth=2, maxIter=5, seed=1)
    order = [r["feature"] for r in M.importances(model, train).collect()]
    assert order[0] == "a"
    scored = M.with_probability(model.transform(train))
    assert scored.where("score < 0 or score > 1").count() == 0


def test_hidden_layer_gives_the_models_output(train):
    model = M.fit_mlp(train, "labels", COLS, [4, 3], seed=2, maxIter=15)
    hidden = {r["id"]: np.array(r["hidden"]) for r in M.hidden_representation(model, train, ["id"]).collect()}
    net = model.stages[-1]
    flat = net.weights.toArray()
    last, bias = flat[-8:-2].reshape(3, 2), flat[-2:]
    for r in M.with_probability(model.transform(train)).limit(20).collect():
        raw = hidden[r["id"]] @ last + bias
        p = np.exp(raw - raw.max())
        assert p[1] / p.sum() == pytest.approx(r["score"], abs=1e-6)


def test_named_queries_fit_whole_models(monkeypatch, spark, small):
    from daypanel.plans import model_queries as Q

    fitted = []
    for name in ("fit_gbt", "fit_mlp"):
        monkeypatch.setattr(Q.M, name, lambda *a, f=getattr(M, name), **b: fitted.append(f(*a, **b)) or fitted[-1])
    Q.gbt_scores(spark, small)
    Q.mlp_scores(spark, small)
    trees, net = (m.stages[-1] for m in fitted)
    assert trees.getNumTrees == 100 and trees.getOrDefault("maxDepth") == 6
    assert list(net.getLayers()[1:-1]) == [128, 128, 128, 64, 32, 16, 3] and net.getOrDefault("maxIter") == 50
    assert Q.gbt_importance(spark, small, rounds=2, depth=2).count() > 0
    assert Q.hidden_representation(spark, small, layers=[4, 2], iterations=3).columns == ["user_id", "labels", "h0", "h1"]


def test_folds_are_dealt_once_for_all_fits(spark, medium, monkeypatch):
    """A linear fit reads its rows once a step: without keeping the folds each step dealt them anew."""
    seen, fit = [], M.cross_validate
    monkeypatch.setattr(M, "cross_validate", lambda pipeline, df, *a, **k: seen.append(df.storageLevel.useMemory) or fit(pipeline, df, *a, **k))
    assert QUERIES["logistic_cross_validated"](spark, medium).count() == 1
    assert seen == [True]


def test_fits_read_few_partitions_whatever_the_setting(spark, medium, monkeypatch):
    """Every step of a fit has a task per partition: shuffles in many partitions made the steps slow."""
    from daypanel.plans import model_queries as Q

    seen = []
    for name in ("fit_gbt", "fit_mlp", "fit_logistic", "cross_validate"):
        at = 1 if name == "cross_validate" else 0
        monkeypatch.setattr(
            M, name, lambda *a, n=name, at=at, f=getattr(M, name), **k: seen.append((n, a[at].rdd.getNumPartitions())) or f(*a, **k)
        )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    try:
        Q.gbt_scores(spark, medium, rounds=1, depth=2)
        Q.gbt_importance(spark, medium, rounds=1, depth=2)
        Q.gbt_split_importance(spark, medium, rounds=1, depth=2)
        Q.mlp_scores(spark, medium, layers=[2], iterations=2)
        Q.random_search(spark, medium, trials=1)
        Q.logistic_cross_validated(spark, medium)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [("fit_gbt", 1)] * 3 + [("fit_mlp", 1), ("fit_logistic", 1), ("cross_validate", 1)]


def test_dealt_rows_are_whole_and_few_partitions_are_kept_often(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS x")
    kept = M.dealt(df, ["id"], per=300, readers=8)
    assert kept.rdd.getNumPartitions() == 4 and kept.storageLevel.replication == 2
    assert sorted(kept.collect()) == sorted(df.collect())
    assert M.dealt(df.repartition(7), ["id"], per=300).rdd.glom().collect() == kept.rdd.glom().collect()
