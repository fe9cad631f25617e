"""Neighbours by brute force, resampling invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.operators import neighbours as N
from daypanel.operators import pivot_tree
from daypanel.operators import resample as B
from daypanel.operators.neighbours import nearest
from daypanel.operators.pivot_tree import PivotTree, closest, distances
from daypanel.plans.standins import vectors


def distance(v, w):
    """Squares summed one dimension after the other, as on every machine."""
    total = 0.0
    for x, y in zip(v, w, strict=True):
        total += (x - y) * (x - y)
    return float(np.sqrt(total))


def brute(rows, k):
    out = {}
    for i, v in rows:
        d = sorted((distance(v, w), j) for j, w in rows if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, with a third of all rows being copies of one vector."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append((i, [1.0, 1.0, 1.0]))
        else:
            centre = rng.choice([0.0, 5.0, 40.0])
            rows.append((i, [round(centre + rng.gauss(0, 1), 1) for _ in range(3)]))
    return spark.createDataFrame(rows, "id long, vector array<double>"), rows


@pytest.mark.parametrize(("block_rows", "leaf_rows"), [(7, 20), (64, 5), (4096, 1024), (16, 300)])
def test_nearest_equals_brute_force(clustered, block_rows, leaf_rows):
    df, rows = clustered
    got = {}
    for r in nearest(df, "id", "vector", 4, block_rows=block_rows, leaf_rows=leaf_rows).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    assert {i: [n[p] for p in sorted(n)] for i, n in got.items()} == brute(rows, 4)


def test_nearest_with_exact_ties(spark):
    """Whole-number vectors, many at equal distances: the smaller id comes first."""
    rows = [(i, [float(i % 5), float(i // 5 % 5), float(i % 2)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in nearest(df, "id", "vector", 3, block_rows=16, leaf_rows=9).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    assert {i: [n[p] for p in sorted(n)] for i, n in got.items()} == brute(rows, 3)


def test_tree_bounds_hold_and_clusters_meet_few_leaves():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 30, (40, 6))
    rows = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 6))
    tree = PivotTree(rows[::5], 64)
    paths, far = tree.place(rows)
    assert (tree.children == 0).sum() == 64 and max(map(len, paths)) >= 2
    nodes = {}
    for p, f in zip(paths, far, strict=True):
        for node, d in zip(p, f, strict=True):
            n, radius = nodes.get(node, (0, 0.0))
            nodes[node] = (n + 1, max(radius, d))
    tree.measure(nodes, len(rows))
    leaf = np.array([p[-1] for p in paths])
    d = distances(rows[:300], rows)
    tenth = np.sort(d, axis=1)[:, 9]
    row, found = tree.visits(rows[:300], tenth)
    visited = {(r, f) for r, f in zip(row.tolist(), found.tolist(), strict=True)}
    for i in range(300):
        assert {(i, leaf[j]) for j in np.flatnonzero(d[i] <= tenth[i])} <= visited
        assert np.sort(d[i])[9] <= tree.reach(paths[i], far[i], 10)
    assert sum(tree.counts[f] for _, f in visited) < 0.1 * 300 * len(rows)
    assert tree.reach([], [], 1) == np.inf


def test_candidate_pairs_stay_far_below_all_pairs(spark):
    """Round one compares a vector with its leaf, round two with the leaves still in reach."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 30, (50, 8))
    vectors_ = centres[rng.integers(0, 50, 6000)] + rng.normal(0, 1, (6000, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors_)], "id long, vector array<double>")
    heads = N.distinct_heads(df, 3)
    placed, tree = N.plant(heads, leaf_rows=100)
    first = N._within_leaves(placed, tree, 3, [], 4096)
    sent = N.visits(placed, N._best(first, 3, []), tree, 3)
    leaf_sizes = {int(n): int(tree.counts[n]) for n in np.flatnonzero(tree.children == 0)}
    own = sum(n * n for n in leaf_sizes.values())
    further = sum(r["n"] * leaf_sizes[r["leaf"]] for r in sent.groupBy("leaf").agg(F.count("*").alias("n")).collect())
    assert own + further < 0.1 * 6000**2


@pytest.mark.parametrize("form", ["plain", "ties", "far", "huge", "tiny", "corners"])
@pytest.mark.parametrize("keep", [1, 6])
def test_closest_takes_few_distances_and_loses_none(form, keep, monkeypatch):
    """What the matrix product rules out is never one of the nearest, whatever the digits; ties go to the smaller column."""
    rng = np.random.default_rng(7)
    a, b = {
        "plain": lambda: (rng.normal(size=(300, 16)), rng.normal(size=(900, 16))),
        "ties": lambda: (rng.integers(0, 3, (300, 4)).astype(float), rng.integers(0, 3, (900, 4)).astype(float)),
        "far": lambda: (1e8 + rng.normal(size=(300, 5)), 1e8 + rng.normal(size=(900, 5))),
        "huge": lambda: (1e200 * rng.normal(size=(30, 5)), 1e200 * rng.normal(size=(900, 5))),
        "tiny": lambda: (1e-170 * rng.normal(size=(30, 5)), 1e-170 * rng.normal(size=(900, 5))),
        "corners": lambda: (np.eye(300), np.eye(300)),
    }[form]()
    taken = []
    real = pivot_tree._pair_distances
    monkeypatch.setattr(pivot_tree, "_pair_distances", lambda x, y: taken.append(len(x)) or real(x, y))
    with np.errstate(over="ignore"):
        d = distances(a, b)
        for limit in (np.full(len(a), np.inf), 0.8 * np.median(d, axis=1)):
            taken.clear()
            meetings = [(np.arange(len(a)), np.arange(i, len(b), 3)) for i in range(3)]
            row, column, distance = closest(a, b, limit, keep, meetings)
            want = [(i, j, d[i, j]) for i in range(len(a)) for j in d[i].argsort(kind="stable")[:keep] if not d[i, j] > limit[i]]
            assert list(zip(row.tolist(), column.tolist(), distance.tolist(), strict=True)) == want
            assert form != "plain" or sum(taken) < 0.1 * d.size


def test_a_vector_is_sent_to_sections_and_not_to_leaves(spark):
    """Without structure each vector visits nearly all leaves: it moves once per section all the same."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    placed, tree = N.plant(N.distinct_heads(spark.createDataFrame(rows, "id long, vector array<double>"), 2), leaf_rows=30)
    best = N._best(N._within_leaves(placed, tree, 2, [], 4096), 2, [])
    plan = N.sections(tree, 700)
    sent = N.section_visits(placed, best, tree, 2, plan).collect()
    leaves = {r["query"]: r["n"] for r in N.visits(placed, best, tree, 2).groupBy("query").agg(F.count("*").alias("n")).collect()}
    assert sum(leaves.values()) > 3000 * 50
    assert len(set(plan["section"])) <= 5 and max(len(r["sections"]) for r in sent) <= 5
    marked = {r["query"]: sum(int.from_bytes(bytes(x), "big").bit_count() for x in r["leaves"]) for r in sent}
    assert {q: n for q, n in marked.items() if n} == leaves


def test_upsample_never_loses_a_class(spark):
    more = spark.createDataFrame([(i, int(i < 7)) for i in range(10)], "id int, y int")
    assert {r["y"]: r["n"] for r in B.class_counts(B.upsample(more, "y"), "y").collect()} == {0: 3, 1: 7}
    for label in (None, 2):
        with pytest.raises(ValueError):
            B.upsample(more.unionByName(spark.createDataFrame([(99, label)], "id int, y int")), "y")


def test_smote_needs_two_minority_rows(spark):
    df = spark.createDataFrame([(i, int(i == 0), float(i)) for i in range(5)], "id long, y int, x double")
    with pytest.raises(ValueError):
        B.smote_nc(df, "id", "y", ["x"], [])


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, vector array<double>")
    assert [(r["id"], r["neighbour"]) for r in nearest(df, "id", "vector", 5).orderBy("id").collect()] == [(1, 2), (2, 1)]
    assert nearest(df.where("id = 1"), "id", "vector", 2).count() == 0
    assert nearest(df.where("id = 9"), "id", "vector", 2).count() == 0


def test_carried_columns(spark, clustered):
    df, _ = clustered
    tagged = df.withColumn("tag", F.col("id") * 10).withColumn("pair", F.array(F.col("id").cast("double")))
    rows = nearest(tagged, "id", "vector", 2, carry=["tag", "pair"]).collect()
    assert all(r["neighbour_tag"] == r["neighbour"] * 10 and r["neighbour_pair"] == [r["neighbour"]] for r in rows)


def test_tomek_links_cross_classes_and_majority_removal(spark, medium):
    df = vectors(spark, medium)
    label = {r["vec_id"]: r["label"] for r in df.collect()}
    links = B.tomek_links(df, "vec_id", "label", "vector").collect()
    assert links and all(label[r["a"]] != label[r["b"]] for r in links)
    ends = [e for r in links for e in (r["a"], r["b"])]
    assert len(ends) == len(set(ends))
    kept = {r["vec_id"] for r in B.remove_tomek(df, "vec_id", "label", "vector", remove="majority").collect()}
    assert set(label) - kept == {e for e in ends if label[e] == 0}


@pytest.fixture(scope="module")
def imbalanced(spark):
    rng = random.Random(8)
    rows = [
        (i, 1 if i % 7 == 0 else 0, rng.gauss(0, 1), rng.gauss(3, 2), float(i % 14 == 0), float(i % 5 == 0))
        for i in range(210)
    ]
    return spark.createDataFrame(rows, "id long, label int, x double, y double, CC_a double, CC_b double"), rows


def test_smote_balances_and_interpolates(imbalanced):
    df, rows = imbalanced
    out = B.smote_nc(df, "id", "label", ["x", "y"], ["CC_a", "CC_b"], k=3).collect()
    made = [r for r in out if r["synthetic"] == 1]
    assert len(out) == 360 and len(made) == 150
    assert all(r["label"] == 1 and r["id"] is None for r in made)
    rare = np.array([(r[2], r[3]) for r in rows if r[1] == 1])
    low, high = rare.min(axis=0), rare.max(axis=0)
    for r in made:
        assert low[0] <= r["x"] <= high[0] and low[1] <= r["y"] <= high[1]
        assert r["CC_a"] in (0.0, 1.0) and r["CC_b"] in (0.0, 1.0)
        p = np.array([r["x"], r["y"]])
        # On a segment between two minority rows.
        a, b = rare[:, None, :], rare[None, :, :]
        detour = np.linalg.norm(a - p, axis=2) + np.linalg.norm(b - p, axis=2) - np.linalg.norm(a - b, axis=2)
        assert detour.min() < 1e-9


def test_smote_is_repeatable(imbalanced):
    df, _ = imbalanced
    key = lambda d: sorted((r["x"], r["y"], r["CC_a"]) for r in d.collect())
    args = ("id", "label", ["x", "y"], ["CC_a", "CC_b"])
    assert key(B.smote_nc(df, *args)) == key(B.smote_nc(df.repartition(3), *args))


def test_smote_tomek_has_no_links_of_originals_left_untouched(imbalanced):
    df, _ = imbalanced
    full = B.smote_nc(df, "id", "label", ["x", "y"], ["CC_a"]).count()
    cleaned = B.smote_tomek(df, "id", "label", ["x", "y"], ["CC_a"]).count()
    assert 0 < cleaned <= full


def test_weights_and_upsample(imbalanced):
    df, _ = imbalanced
    weights = {r["label"]: r["classWeightCol"] for r in B.class_weights(df, "label").collect()}
    assert weights[1] == pytest.approx(180 / 210) and weights[0] == pytest.approx(30 / 210)
    assert {r["label"]: r["n"] for r in B.class_counts(B.upsample(df, "label"), "label").collect()} == {0: 180, 1: 180}
