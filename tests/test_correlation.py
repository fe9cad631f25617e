"""Correlations by tiles against numpy."""

import numpy as np
import pytest

from daypanel.operators import correlation as C


def table(spark, x):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, [f"c{i}" for i in range(x.shape[1])])


def brute(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b = x[both, i], x[both, j]
            if i != j:
                constant = len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0
                out[f"c{i}", f"c{j}"] = None if constant else np.corrcoef(a, b)[0, 1]
    return out


@pytest.mark.parametrize("tile", [1, 3, 4, 7, 100])
def test_equals_numpy_whatever_the_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    x = rng.integers(-5, 6, (200, 7)).astype(float)
    x[:, 3] = 7.0
    x[:, 4] += 1e6
    x[rng.random((200, 7)) < 0.1] = np.nan
    rows = C.correlation_long(table(spark, x).repartition(5), [f"c{i}" for i in range(7)], tile).collect()
    got = {(r["index"], r["variable"]): r["value"] for r in rows}
    assert len(rows) == len(got) == 42
    for pair, value in brute(x).items():
        assert got[pair] is None if value is None else got[pair] == pytest.approx(value, abs=1e-9), pair


def test_no_rows_and_no_columns(spark):
    empty = table(spark, np.ones((1, 2))).where("false")
    assert C.correlation_long(empty, ["c0", "c1"]).count() == 0
    assert C.correlation_long(table(spark, np.ones((2, 2))), []).count() == 0
    assert C.correlation_long(table(spark, np.ones((2, 2))), ["c0"]).count() == 0


def test_a_wide_panel_in_bounded_memory(spark):
    """24 series of 71 features: a task's sums are those of one stripe, not of all pairs."""
    p, tile = 1704, 128
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    x = np.repeat(base, 71, axis=1) + 0.3 * rng.normal(size=(60, p))
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").selectExpr(*[f"v[{i}] AS f{i}" for i in range(p)])
    found = C.correlation_long(df, names, tile)
    want = np.corrcoef(x.T)
    rows = found.where("index IN ('f0', 'f700', 'f1703')").collect()
    assert len(rows) == 3 * (p - 1)
    for r in rows:
        assert r["value"] == pytest.approx(want[int(r["index"][1:]), int(r["variable"][1:])], abs=1e-9)
    sums = max(len(r["sums"]) for r in C._stripe_rows(df, names, tile).collect())
    assert sums == 6 * tile * tile * 8
