"""Ordered sums, quantiles, curves, ANOVA tails and selection."""

import datetime
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute_tails import f_tail_value, incomplete_beta, log_gamma_ratio
from check_twins import compare
from daypanel.functions import tails as T
from daypanel.operators import evaluation as V
from daypanel.operators.features import pivot_features
from daypanel.operators import ordered as O
from daypanel.operators import selection as S
from daypanel.operators.encoding import one_hot
from daypanel.plans import selection_queries as Q
from daypanel.plans.registry import TWINS


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    # A third of the rows share one score; the rest are spread very unevenly.
    rows = []
    for i in range(1200):
        score = 0.001 if i % 3 == 0 else round(rng.random() ** 6, rng.choice([2, 3, 6]))
        rows.append((i, score, int(rng.random() < 0.1 + 0.5 * score)))
    return spark.createDataFrame(rows, "id long, score double, label int"), rows


@pytest.mark.parametrize("ranges", [2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(scores, ranges, descending):
    df, rows = scores
    got = O.running_sums(df, "score", {"n": F.lit(1)}, ["label"], descending, ranges).collect()
    for label in (0, 1):
        values = [s for _, s, l in rows if l == label]
        mine = {r["score"]: r for r in got if r["label"] == label}
        assert set(mine) == set(values)
        for s, r in mine.items():
            upto = sum(v >= s if descending else v <= s for v in values)
            assert (r["n"], r["cum_n"], r["all_n"]) == (values.count(s), upto, len(values))


def test_quantiles(scores):
    df, rows = scores
    values = np.array([s for _, s, _ in rows])
    points = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {r["q"]: r["value"] for r in O.exact_quantiles(df, "score", points).collect()}
    assert {q: pytest.approx(float(np.quantile(values, q))) for q in points} == got


def test_hashed_row_numbers(scores):
    df, rows = scores
    got = O.hashed_row_numbers(df, "id", 5, ["label"]).collect()
    again = {r["id"]: r["rn"] for r in O.hashed_row_numbers(df.repartition(3), "id", 5, ["label"], ranges=3).collect()}
    assert {r["id"]: r["rn"] for r in got} == again
    for label in (0, 1):
        mine = sorted(r["rn"] for r in got if r["label"] == label)
        assert mine == list(range(1, sum(l == label for _, _, l in rows) + 1))


def test_curve_is_monotone_and_area_is_rank_statistic(scores):
    df, rows = scores
    points = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in V.roc_points(df, "label", "score").collect())
    assert all(a[1] >= b[1] and a[2] >= b[2] for a, b in zip(points, points[1:]))
    pos = [s for _, s, l in rows if l == 1]
    neg = [s for _, s, l in rows if l == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert V.curve_areas(df, "label", "score").first()["roc_auc"] == pytest.approx(wins)


def test_corner_points_by_definition(scores):
    df, _ = scores
    curve = V.score_curve(df, "label", "score")
    rows = sorted(((r["threshold"], r["pos"], r["neg"]) for r in curve.collect()), reverse=True)
    kept = {
        t for i, (t, p, n) in enumerate(rows) if i in (0, len(rows) - 1) or rows[i + 1][1:] != (p, n)
    }
    assert {r["threshold"] for r in V.corner_points(curve).collect()} == kept


def test_top_share(scores):
    df, rows = scores
    values = sorted((s for _, s, _ in rows), reverse=True)
    for share in (0.0, 0.1, 0.333, 1.0):
        expected = values[min(round(len(values) * share), len(values) - 1)]
        assert V.top_share_threshold(df, "score", share).first()["threshold"] == expected


def test_no_single_partition_window(scores):
    df, _ = scores
    plan = V.score_curve(df, "label", "score")._jdf.queryExecution().executedPlan().toString()
    # The one unpartitioned window runs over the per-range totals.
    assert plan.count("Exchange SinglePartition") <= 1


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    row = V.with_metrics(V.confusion(df, "label", "score", 0.5)).first()
    assert (row["tn"], row["precision"], row["recall"], row["f1"], row["accuracy"]) == (2, 0.0, 0.0, 0.0, 1.0)


def test_beta_and_f_tail():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    # Critical values of published F tables.
    assert f_tail_value(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_tail_value(3.0, 2, 1e6) == pytest.approx(np.exp(-3.0), abs=1e-5)
    assert f_tail_value(0.0, 3, 7) == pytest.approx(1.0)
    assert f_tail_value(float("inf"), 1, 5) == 0.0


def test_tail_expressions_equal_plain_python(spark):
    cases = [(f, a, b) for f in (0.0, 1e-9, 0.3, 1.0, 4.9646, 37.0, 900.0) for a in (1.0, 2.0, 7.0, 150.0) for b in (1.0, 3.0, 10.0, 298.0, 1e5, 1e7)]
    cases += [(float("inf"), 1.0, 5.0), (float("nan"), 1.0, 5.0), (None, 1.0, 5.0), (2.0, 1.0, 0.0)]
    df = spark.createDataFrame(cases, "f double, a double, b double").coalesce(1)
    rows = df.select("f", "a", "b", T.f_tail("f", "a", "b").alias("p")).collect()
    for r in rows:
        want = f_tail_value(r["f"], r["a"], r["b"])
        assert r["p"] is want is None or r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300), r
    betas = df.select(T.incomplete_beta(F.lit(2), F.lit(3), F.lit(0.4)), T.incomplete_beta(F.lit(0.5), F.lit(0.5), F.lit(0.25))).first()
    assert list(betas) == [pytest.approx(0.5248), pytest.approx(1 / 3)]
    gammas = spark.range(1).select(*[T.log_gamma(F.lit(x)) for x in (0.5, 1.0, 2.0, 7.25, 1e6)]).first()
    assert list(gammas) == [pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13) for x in (0.5, 1.0, 2.0, 7.25, 1e6)]


def test_anova_needs_no_python_worker(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.5)], "target int, x double")
    plan = S.anova(df, ["x"], "target")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_anova_against_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=300) + 0.4 * y
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "target int, x double")
    row = S.anova(df, ["x"], "target").first()
    fit = np.polyval(np.polyfit(y, x, 1), y)
    residual, explained = float(((x - fit) ** 2).sum()), float(((fit - x.mean()) ** 2).sum())
    assert row["F"] == pytest.approx(explained / (residual / 298))
    assert row["ss_residual"] == pytest.approx(residual) and row["df_residual"] == 298
    assert 0 < row["p_value"] < 0.05


def test_selection_drops_the_weaker_twin(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = int(i % 2)
        a = float(rng.normal() + 2 * y)
        rows.append((y, a, a + float(rng.normal()) * 0.3, float(rng.normal()), 1.0, None if i == 0 else 1.0 * y))
    df = spark.createDataFrame(rows, "target int, a double, b double, noise double, flat double, holes double")
    chosen, tests = S.select_features(df, ["a", "b", "noise", "flat", "holes"], "target")
    assert chosen == ["a"]
    assert {r["feature"] for r in tests.collect()} == {"a", "b", "noise"}


def test_one_hot_unknown_value(spark):
    df = spark.createDataFrame([("x",), ("q",)], "c string")
    vocabulary = {"c": ["x", "y z"]}
    assert one_hot(df, vocabulary, unknown="ignore").collect()[1].asDict() == {"c_x": 0.0, "c_y_z": 0.0}
    with pytest.raises(Exception, match="not in the vocabulary"):
        one_hot(df, vocabulary).collect()


def test_correlation_uses_every_row_of_a_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 1.0), (3.0, 5.0, 2.0), (4.0, 2.5, 0.0), (5.0, 2.0, None), (None, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["index"], r["variable"]): r["value"] for r in S.correlation_long(df, ["a", "b", "c"]).collect()}
    frame = df.toPandas()
    assert len(got) == 6
    for (i, j), value in got.items():
        assert value == pytest.approx(frame[i].corr(frame[j]), abs=1e-12)


def test_gamma_ratio_keeps_its_digits():

    for d in (0.5, 1.0, 3.5):
        assert log_gamma_ratio(99_999.0, d) == pytest.approx(log_gamma_ratio(100_001.0, d), abs=d * 3e-5)
    # With one and very many degrees of freedom F is the square of a normal value.
    for rows in (1e9, 1e11):
        assert f_tail_value(1.959963984540054**2, 1.0, rows) == pytest.approx(0.05, rel=1e-7)


def test_summary_equals_its_parts_with_nulls(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (None, 0.7), (1, None), (0, 0.3)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = V.evaluate_scores(df, "label", "score").first().asDict()
    best = V.best_threshold(df, "label", "score").first()["threshold"]
    parts = {"threshold": best}
    for part in (V.with_metrics(V.confusion(df, "label", "score", best)), V.curve_areas(df, "label", "score"), V.brier(df, "label", "score")):
        parts |= part.first().asDict()
    assert got == pytest.approx(parts)


def test_pivot_keeps_kinds_apart(spark):
    rows = [(1, "a", 1.0, 2.0), (1, "b", None, 4.0), (2, "b", 5.0, 6.0)]
    wide = pivot_features(spark.createDataFrame(rows, "id long, kind string, f double, `g__q_0.1` double"), "id", ["a", "b"])
    assert wide.columns == ["id", "a__f", "a__g__q_01", "b__f", "b__g__q_01"]
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 2.0, None, 4.0), (2, None, None, 5.0, 6.0)]


def test_correlation_prune_where_p_underflows(spark, tmp_path):
    """1,500 users whose counts, totals and means all have a p of 0: F alone says which is weaker."""
    rng = np.random.default_rng(5)
    rows = []
    for user in range(1500):
        hit = user % 2
        late = datetime.datetime(2024, 1, 26)
        rows += [(user, late, "error", 150.0 if hit else 50.0)]
        rows += [(user, late, kind, 10.0) for kind in Q.EVENT_SERIES.values() for _ in range(int(rng.integers(0, 2)))]
        rows += [(user, late, "click", (200.0 if hit else 40.0) + float(rng.integers(0, 20))) for _ in range(4 + 5 * hit + int(rng.integers(0, 4)))]
    events = pd.DataFrame([(i, ts, user, kind, value, '{"k": 1}') for i, (user, ts, kind, value) in enumerate(rows)])
    events.columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    tests = S.anova(Q.matrix(spark, str(tmp_path)), Q.USABLE, "target").where("p_value = 0")
    assert tests.count() > 2
    ok, text = compare(spark, con, str(tmp_path), "correlation_prune", Q.correlation_prune, TWINS["correlation_prune"])
    assert ok and " 0 rows" not in text, text
