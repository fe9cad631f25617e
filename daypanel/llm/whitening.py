"""Whitening of embeddings: leading principal components of the distinct vectors, by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm.text import named
from daypanel.sources.tables import written

#: Points of the contour's upper half, eigenvalues that one contour is meant to hold, and rounds it may take.
NODES, HELD, ROUNDS = 16, 8, 40
#: Eigenvalues below this share of the largest are zero but for rounding.
ZERO = 1e-12
#: Rows whose products are summed at once.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Whitening:
    """What is fitted: its size grows with the vectors' length only."""

    n: int  #: distinct vectors
    sums: np.ndarray  #: their sum per dimension, whole numbers
    values: np.ndarray  #: eigenvalues of the covariance, falling
    vectors: np.ndarray  #: unit eigenvectors, one per row
    trace: float  #: of the covariance

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are positive, negative and zero, by Sylvester's law.

    The signs are those of the blocks of a symmetric factorisation with Bunch-Kaufman pivots.
    """
    a = np.array(a, float)
    n, k, signs = len(a), 0, [0, 0, 0]
    bound = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        width, below = 1, np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        if most == 0 or abs(a[k, k]) >= bound * most:
            pass
        else:
            r = k + 1 + int(below.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            side = column.max()
            if abs(a[k, k]) * side >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * side:
                swap(k, r)
            else:
                swap(k + 1, r)
                width = 2
        block = a[k : k + width, k : k + width]
        if width == 1:
            pivot = block[0, 0]
            signs[0 if pivot > 0 else 1 if pivot < 0 else 2] += 1
            if pivot == 0:
                k += 1
                continue
        else:
            # Such a block has a negative determinant: one eigenvalue of either sign.
            signs[0] += 1
            signs[1] += 1
        rest = a[k + width :, k : k + width]
        a[k + width :, k + width :] -= rest @ np.linalg.solve(block, rest.T)
        k += width
    return signs[0], signs[1], signs[2]


def above(matrix: np.ndarray, edge: float) -> int:
    """Eigenvalues above `edge`."""
    return inertia(matrix - edge * np.eye(len(matrix)))[0]


def _edge(matrix: np.ndarray, wanted: int, low: float, high: float) -> tuple[float, int]:
    """An edge with `wanted` eigenvalues above it, well inside the gap there, or with more where equal ones leave no gap.

    At least `wanted` are above `low` and fewer above `high`.
    """
    tiny = 1e-13 * max(abs(low), abs(high))
    while high - low > tiny:
        middle = (low + high) / 2
        n = above(matrix, middle)
        if n == wanted:
            ends = []
            for other, closer in ((low, middle), (high, middle)):
                for _ in range(12):
                    half = (other + closer) / 2
                    other, closer = (other, half) if above(matrix, half) == wanted else (half, closer)
                ends.append(closer)
            return sum(ends) / 2, wanted
        low, high = (middle, high) if n > wanted else (low, middle)
    return low, above(matrix, low)


def slices(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that hold the k largest eigenvalues, some `HELD` each, highest first."""
    size = float(np.abs(matrix).sum(axis=1).max())
    top, bottom, out, found = size * 1.01, -size * 1.01, [], 0
    while found < k:
        low, n = _edge(matrix, min(found + HELD, k), bottom, top) if min(found + HELD, k) < len(matrix) else (bottom, len(matrix))
        high, floor = top, low
        # Down to where eigenvalues begin, and a little above that: a narrow circle damps the outside better.
        while above(matrix, (high + floor) / 2) == found and high - low > 1e-12 * size:
            high = (high + floor) / 2
        out.append((low, min(top, high + (high - low) / 8), n - found))
        found, top = n, low
    return out


def _filtered(spark: SparkSession, matrix: np.ndarray, jobs: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """For each (low, high, y): y with what lies outside the interval damped, by quadrature over a circle around it.

    Every point of every circle is one solve, (z - matrix) x = y, of complex numbers; each is a row that Spark deals to a task.
    """
    sent = spark.sparkContext.broadcast((matrix, jobs))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, given = sent.value
        for frame in frames:
            found = []
            for job, node in zip(frame["job"], frame["node"], strict=True):
                low, high, y = given[job]
                turn = (high - low) / 2 * np.exp(1j * np.pi * (node + 0.5) / NODES)
                x = np.linalg.solve(((low + high) / 2 + turn) * np.eye(len(a)) - a, y.astype(complex))
                found.append(np.ascontiguousarray((turn * x).real / NODES).tobytes())
            yield pd.DataFrame({"job": frame["job"], "part": found})

    points = len(jobs) * NODES
    nodes = spark.range(0, points, 1, points).select(
        F.floor(F.col("id") / NODES).cast("int").alias("job"), (F.col("id") % NODES).cast("int").alias("node")
    )
    out = [np.zeros_like(y) for _, _, y in jobs]
    for row in sorted(nodes.mapInPandas(solve, "job int, part binary").collect()):
        out[row["job"]] += np.frombuffer(row["part"]).reshape(out[row["job"]].shape)
    sent.destroy()
    return out


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, falling, and vectors (columns) in the span of `basis`."""
    q, _ = np.linalg.qr(basis)
    q, _ = np.linalg.qr(q)
    small = q.T @ matrix @ q
    values, turns = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (q @ turns)[:, ::-1]


def leading(spark: SparkSession, matrix: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors, one per row.

    Inertia counts place intervals that hold them. In each a random subspace is
    filtered by contour integration and Rayleigh-Ritz extracts pairs from it,
    again and again, until as many lie inside as the count says and their
    residuals no longer fall. An interval that is not done after some rounds
    gets a larger subspace.
    """
    d = len(matrix)
    random = np.random.default_rng(seed)
    size = float(np.abs(matrix).sum(axis=1).max())
    jobs = [
        {"low": low, "high": high, "n": n, "y": random.standard_normal((d, min(d, 2 * n + 8))), "left": np.inf, "done": None}
        for low, high, n in slices(matrix, k)
    ]
    for round_ in range(ROUNDS):
        open_ = [j for j in jobs if j["done"] is None]
        if not open_:
            break
        filtered = _filtered(spark, matrix, [(j["low"], j["high"], j["y"]) for j in open_])
        for job, q in zip(open_, filtered, strict=True):
            values, vectors = _ritz(matrix, q)
            inside = (values > job["low"]) & (values <= job["high"])
            x = vectors[:, inside]
            left = np.abs(matrix @ x - x * values[inside]).max(initial=0.0)
            if inside.sum() == job["n"] and left <= 1e-11 * size and left >= job["left"] / 2:
                job["done"] = x
            elif round_ % 4 == 3 and vectors.shape[1] < d:
                job.update(y=np.hstack([vectors, random.standard_normal((d, min(job["n"], d - vectors.shape[1])))]), left=np.inf)
            else:
                job.update(y=vectors, left=left if inside.sum() == job["n"] else np.inf)
    if any(j["done"] is None for j in jobs):
        raise ArithmeticError("a contour has not converged")
    if not jobs:
        return np.zeros(0), np.zeros((0, d))
    # All intervals together once more, which makes vectors of neighbouring ones orthogonal.
    values, vectors = _ritz(matrix, np.hstack([j["done"] for j in jobs]))
    return values[:k], np.ascontiguousarray(vectors[:, :k].T)


def _stacked(column: pa.Array, d: int) -> np.ndarray:
    return np.array(column.flatten(), np.int64).reshape(len(column), d)


def _sums(fit: DataFrame, d: int) -> np.ndarray:
    """The exact sum of each dimension, one row per dimension from each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _stacked(batch.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(d, np.int64)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def _products(fit: DataFrame, d: int, about: np.ndarray) -> np.ndarray:
    """The exact sums of products of any two dimensions, both measured from the whole numbers `about`."""
    one, two = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), np.int64)
        for batch in batches:
            x = _stacked(batch.column(0), d) - about
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = x[at : at + ROWS_AT_ONCE]
                most = float(np.abs(part).max()) ** 2 * len(part)
                if most >= 2.0**62:
                    raise OverflowError("a product does not fit into 64 bits")
                # Products of doubles are exact below 2**53.
                total += (part.T.astype(float) @ part.astype(float)).astype(np.int64) if most < 2.0**53 else part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(total[one, two])], ["i", "j", "s"]
        )

    rows = fit.select("x").mapInArrow(add, "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((d, d))
    for r in rows.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = float(r["s"])
    return out


def _sound(table: DataFrame, vector: str) -> DataFrame:
    """(x) of the rows whose vector is not null and has no nulls."""
    x = table.select(named(vector).cast("array<long>").alias("x"))
    return x.filter(F.forall("x", lambda c: c.isNotNull()))


def length_of(table: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the longest of equally common ones; 0 without any."""
    sizes = _sound(table, vector).groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "d")).alias("best")).first()["best"]
    return row["d"] if row else 0


def fit_whitening(table: DataFrame, vector: str = "vector", components: int = 16) -> tuple[Whitening, DataFrame]:
    """The whitening of `table`, and the stored list (x) of distinct vectors that it is fitted on.

    `vector` has whole numbers. Each distinct vector counts once. Spark sums
    dimensions, then products of two dimensions measured from the rounded mean,
    so that the covariance is centred before anything is multiplied and its sums
    are exact, in any order. Only these d and d * d sums reach the driver. The
    leading components come from `leading`; those whose eigenvalue is zero but
    for rounding are none, so there may be fewer than `components`.

    Vectors that are null or hold a null, or of another length than the
    commonest, are left out. Without vectors, or with a single distinct one,
    there are no components.
    """
    d = length_of(table, vector)
    fit = written(_sound(table, vector).filter(F.size("x") == d).distinct())
    n = fit.count() if d else 0
    none = Whitening(n, np.zeros(d, np.int64), np.zeros(0), np.zeros((0, d)), 0.0)
    if n == 0:
        return none, fit
    sums = _sums(fit, d)
    about = sums // n
    past = (sums - n * about) / n
    covariance = _products(fit, d, about) / n - np.outer(past, past)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return Whitening(n, sums, none.values, none.vectors, 0.0), fit
    rank = above(covariance, ZERO * float(np.abs(covariance).sum(axis=1).max()))
    values, vectors = leading(table.sparkSession, covariance, min(components, rank))
    return Whitening(n, sums, values, vectors, trace), fit


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    about = model.sums // model.n
    past = (model.sums - model.n * about) / model.n
    return ((x - about) - past) @ (model.vectors.T / np.sqrt(model.values))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened `fit` (x) differs from the identity; 0 without components."""
    k, d = len(model.values), len(model.sums)
    if not k:
        return 0.0
    sent = fit.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _whitened(_stacked(batch.column(0), d), sent.value)
            total += z.sum(axis=0)
            products += z.T @ z
        whole = np.vstack([products, total])
        i, j = np.indices(whole.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(whole.ravel())], ["i", "j", "s"]
        )

    whole = np.zeros((k + 1, k))
    for r in fit.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        whole[r["i"], r["j"]] = r["s"]
    # The whitened values are centred but for rounding; that rest goes too.
    mean = whole[k] / model.n
    return float(np.abs(whole[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, model: Whitening, vector: str = "vector", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of `table` that the model holds for, with `whitened`, array<double>, and `deviation`, long.

    `whitened` are the centred vector's coordinates along the components, each
    over the root of its eigenvalue; `deviation` is the sum over all dimensions
    of (n * x - sum)**2, exact, and an error where that needs more than 64 bits.
    Rows that a fit leaves out (see `fit_whitening`) go; equal rows stay, each
    with the same values. All other columns stay, whatever their names; columns
    named like the two new ones are replaced.
    """
    d = len(model.sums)
    sent = table.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        about = known.sums // known.n
        rest = known.sums - known.n * about
        for batch in batches:
            x = _stacked(batch.column(1), d)
            z = _whitened(x, known)
            near = x - about
            if float(known.n) ** 2 * ((near - rest / known.n) ** 2).sum(axis=1).max(initial=0.0) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a deviation does not fit into 64 bits")
            apart = ((known.n * near - rest) ** 2).sum(axis=1)
            bounds = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(z.ravel())), pa.array(apart)], ["row", "z", "apart"]
            )

    kept = [c for c in table.columns if c not in (whitened, deviation)]
    rows = table.select(F.struct(*[named(c) for c in kept]).alias("row"), named(vector).cast("array<long>").alias("x"))
    sound = rows.filter(F.forall("x", lambda c: c.isNotNull()) & (F.size("x") == d) & F.lit(model.n > 0))
    schema = sound.select("row", F.array(F.lit(0.0)).alias("z"), F.lit(0).cast("long").alias("apart")).schema
    out = sound.mapInArrow(project, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("z").alias(whitened), F.col("apart").alias(deviation))
