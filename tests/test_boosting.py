"""Search by halving, and importances against a recursive SQL over the same trees."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from daypanel.operators import boosting as B
from daypanel.operators import models as M

COLS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        y = float(i % 4 == 0)
        rows.append((i, y, rng.gauss(1.5 * y, 1), rng.gauss(-y, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id long, labels double, a double, b double, noise double").persist()
    return df.where("id % 10 < 7"), df.where("id % 10 >= 7")


def test_search_halves_and_repeats(parts):
    train, validation = parts
    small = {**B.TREE_SPACE, "depth": M.choice([1, 2, 3]), "positive": M.choice([1, 3, 10])}
    run = lambda parallel: B.search_trees(train, validation, "labels", COLS, trials=9, seed=3, space=small, rounds=9, parallel=parallel)
    table, best, model = run(4)
    rows = table.collect()
    by_rung = {k: {r["trial"] for r in rows if r["rung"] == k} for k in (0, 1)}
    assert [len(by_rung[k]) for k in (0, 1)] == [9, 3] and by_rung[1] < by_rung[0]
    assert {(r["rung"], r["rounds"]) for r in rows} == {(0, 3), (1, 9)}
    first = sorted((-r["score"], r["trial"]) for r in rows if r["rung"] == 0)
    assert by_rung[1] == {t for _, t in first[:3]}
    last = min((-r["score"], r["trial"], r["params"]) for r in rows if r["rung"] == 1)
    assert last[2] == {k: str(v) for k, v in best.items()}
    assert model.stages[-1].getNumTrees == 9 and "prediction" in model.transform(validation).columns
    again, best_again, _ = run(1)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows)) and best == best_again


def test_defaults_are_the_published_search():
    assert (B.TRIALS, B.ROUNDS) == (300, 100)
    rng = random.Random(0)
    drawn = [{k: f(rng) for k, f in B.TREE_SPACE.items()} for _ in range(500)]
    assert {d["depth"] for d in drawn} == {2, 4, 6, 8, 10} and {d["positive"] for d in drawn} == set(range(100, 451, 50))
    assert all(0.0497 < d["rate"] < 0.2232 and d["subsample"] == 0.5 for d in drawn)


def test_importance_equals_recursive_sql(spark, parts, tmp_path):
    train, _ = parts
    model = M.fit_gbt(train, "labels", COLS, maxDepth=4, maxIter=6, seed=2)
    trees = B.tree_table(model)
    trees.toPandas().to_parquet(tmp_path / "trees.parquet")
    train.toPandas().to_parquet(tmp_path / "rows.parquet")
    con = duckdb.connect()
    want = con.execute(f"""
      WITH RECURSIVE trees AS (SELECT * FROM '{tmp_path}/trees.parquet'),
      data AS (SELECT id, unnest(['a', 'b', 'noise']) AS feature, unnest([a, b, noise]) AS value FROM '{tmp_path}/rows.parquet'),
      walk AS (
        SELECT d.id, t.tree, 0 AS node FROM (SELECT DISTINCT id FROM data) d, (SELECT DISTINCT tree FROM trees) t
        UNION ALL
        SELECT w.id, w.tree, CASE WHEN d.value <= t."threshold" THEN t."left" ELSE t."right" END
        FROM walk w JOIN trees t ON t.tree = w.tree AND t.node = w.node AND t."left" >= 0 JOIN data d ON d.id = w.id AND d.feature = t.feature),
      met AS (SELECT tree, node, count(*) AS n FROM walk GROUP BY tree, node)
      SELECT feature, count(*) AS weight, avg(coalesce(n, 0)) AS cover, avg(gain) AS gain
      FROM trees LEFT JOIN met USING (tree, node) WHERE "left" >= 0 GROUP BY feature ORDER BY feature""").fetchall()
    got = sorted(tuple(r) for r in B.split_importance(model, train).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2:] for r in got] == [pytest.approx(r[2:]) for r in want]
    assert len(B.split_importance(model, train, top=2).collect()) == 2


def test_paths_end_where_the_model_predicts(spark, parts):
    train, _ = parts
    model = M.fit_gbt(train, "labels", COLS, maxDepth=3, maxIter=1, seed=2)
    trees = B.tree_table(model)
    assert B.tree_depth(trees) == model.stages[-1].trees[0].depth
    ends = B.walked_paths(train, trees, ["id"]).select("id", F.element_at("path", -1).alias("node"))
    leaves = ends.join(trees.select("node", "prediction"), "node").select("id", "prediction")
    signs = {r["id"]: r["prediction"] > 0 for r in leaves.collect()}
    assert signs == {r["id"]: r["prediction"] == 1.0 for r in model.transform(train).select("id", "prediction").collect()}


def test_a_tree_without_splits(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "labels double, a double")
    model = M.fit_gbt(df, "labels", ["a"], maxDepth=2, maxIter=1, subsample=1.0)
    assert B.split_importance(model, df).count() == 0
    assert [r["path"] for r in B.walked_paths(df, B.tree_table(model), []).collect()] == [[0], [0]]
