"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.llm import whitening
from daypanel.llm.queries import op12_whitening
from daypanel.sources.tables import load


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 100, 40),
    "falling": 2.0 ** -np.arange(30),
    "equal ones": [5.0] * 6 + [3.0] * 12 + [1.0] * 5,
    "all equal": [2.0] * 12,
    "low rank": [9, 4, 1] + [0.0] * 20,
    "close": 1 + np.arange(24) * 1e-6,
    "either sign": np.linspace(-3, 3, 21),
    "one": [7.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts_signs(name):
    values = np.sort(np.asarray(SPECTRA[name], float))
    a = symmetric(values)
    for edge in [values[0] - 1, values[-1] + 1, *((values[:-1] + values[1:]) / 2)[np.diff(values) > 1e-9]]:
        assert whitening.above(a, edge) == (values > edge).sum()


def test_inertia_of_pivots_that_vanish():
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]])) == (1, 1, 0)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3)
    assert whitening.inertia(np.diag([1.0, 0, -2])) == (1, 1, 1)


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("k", [1, 7, 16])
def test_leading_pairs(spark, name, k):
    values = np.sort(np.asarray(SPECTRA[name], float))[::-1]
    k = min(k, len(values))
    a = symmetric(values)
    found, vectors = whitening.leading(spark, a, k)
    size = np.abs(values).max()
    assert np.abs(found - values[:k]).max() <= 1e-12 * size
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() <= 1e-12
    assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-12 * size


def integers(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = np.floor(64 * rng.standard_normal((n, d)) @ np.diag(np.linspace(0.1, 1, d)) @ rng.standard_normal((d, d)) / d) + 1_000_000
    return x.astype(np.int64)


def table_of(spark, x):
    return spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, vector array<long>")


def dense(distinct, k):
    s, n = distinct.sum(axis=0), len(distinct)
    centred = distinct - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return s, n, centred, values[::-1][:k], vectors[:, ::-1][:, :k]


def test_whole_whitening(spark):
    x = integers(300, 24)
    x = np.vstack([x, np.repeat(x[:1], 500, axis=0)])
    distinct = np.unique(x, axis=0)
    s, n, centred, values, vectors = dense(distinct, 16)
    table = table_of(spark, x).withColumn("a.b", F.lit("stays")).withColumn("row", F.lit(1)).withColumn("z", F.lit(2))
    model, fit = whitening.fit_whitening(table)
    assert (model.n, model.sums.tolist()) == (n, s.tolist())
    assert np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(model.explained, values / np.trace(centred.T @ centred / n), rtol=1e-12)
    assert whitening.identity_error(fit, model) < 1e-10
    out = whitening.whiten(table, model)
    assert out.columns == ["vec_id", "vector", "a.b", "row", "z", "whitened", "deviation"]
    rows = sorted(out.collect())
    assert len(rows) == len(x)
    z = np.array([r["whitened"] for r in rows])
    expected = (x - s / n) @ vectors / np.sqrt(values)
    signs = np.sign((z * expected).sum(axis=0))
    assert np.abs(z - signs * expected).max() < 1e-9
    assert [r["deviation"] for r in rows] == [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True)) for v in x]


def test_odd_rows_and_low_rank(spark):
    x = [[1_000_000 + i, 1_000_000 - 2 * i, 7] for i in range(5)]
    rows = [(i, v) for i, v in enumerate(x)] + [(10, None), (11, [1, None, 2]), (12, []), (13, [1, 2]), (None, x[0]), (0, x[0])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    model, fit = whitening.fit_whitening(table)
    assert model.n == 5
    assert model.values == pytest.approx([10.0])
    assert sorted(str(r["vec_id"]) for r in whitening.whiten(table, model).collect()) == sorted(["0", "1", "2", "3", "4", "None", "0"])
    assert whitening.identity_error(fit, model) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [3, 4]), (2, [3, 4])]])
def test_nothing_to_whiten(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    model, fit = whitening.fit_whitening(table)
    assert len(model.values) == 0
    assert whitening.identity_error(fit, model) == 0.0
    out = whitening.whiten(table, model).collect()
    assert [(r["whitened"], r["deviation"]) for r in out] == [([], 0)] * len([r for r in rows if r[1]])


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        whitening.fit_whitening(spark.createDataFrame([(1, [0]), (2, [1 << 40])], "vec_id long, vector array<long>"))


def test_query(spark, small):
    rows = op12_whitening(spark, small).collect()
    table = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(np.int64) + 1_000_000 for r in load(spark, small, "embeddings").collect()}
    x = np.array([table[k] for k in sorted(table)])
    distinct = np.unique(x, axis=0)
    s, n, centred, values, vectors = dense(distinct, 16)
    assert len(rows) == 16 * len(table)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert {r["n"] for r in rows} == {n}
    assert max(r["identity_error"] for r in rows) < 1e-9
    trace = (centred**2).sum() / n
    for c in range(16):
        z = np.array([got[k, c + 1]["whitened"] for k in sorted(table)])
        expected = (x - s / n) @ vectors[:, c] / np.sqrt(values[c])
        assert np.abs(z - np.sign(z @ expected) * expected).max() < 1e-8
        assert got[0, c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-10)
    for k, v in table.items():
        assert got[k, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
