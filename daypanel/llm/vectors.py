"""Near duplicates among embeddings: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.components import components
from daypanel.sources.tables import written

#: Vectors per cell that are aimed at, most cells, and rows of a block.
CELL, MOST_CELLS, BLOCK = 1024, 1024, 2048
#: Vectors that the cells are fitted on, at most.
SAMPLE = 50_000
NO_KEY = -(1 << 63)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_cells(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """Unit centres of spherical k-means, one per `CELL` vectors and `MOST_CELLS` at most.

    Fitted on `SAMPLE` rows at most, those with the smallest hashes; cells only
    steer the work, as all vectors are assigned and every link is found in any
    division.
    """
    k = max(1, min(MOST_CELLS, n // CELL))
    share = min(1.0, SAMPLE / max(n, 1))
    place = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) / (1 << 30)
    sample = vectors.filter(place < share).select(array_to_vector("vector").alias("features"))
    if k == 1:
        first = vectors.select("vector").first()
        return unit(np.array([first[0]], float)) if first else np.zeros((0, 0))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10, initSteps=2).fit(sample)
    return unit(np.array(model.clusterCenters()))


def _assigner(centres, cosine: float):
    """Each vector at its own cell, and as a visitor in every other in which a linked one may be at home.

    If a vector at chord d or less is at home in cell j, then it lies on the far
    side of the plane between the two centres, which is so no farther than d.
    """
    chord = math.sqrt(2 - 2 * cosine) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows = unit(np.array(batch.column(3).to_pylist(), float))
                near = rows @ c.T
                home = near.argmax(axis=1)
                gap = near[np.arange(len(rows)), home][:, None] - near
                row, cell = np.nonzero(gap <= chord * apart[home] + 1e-9)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                    ["class", "copies", "pool", "vector", "cell", "home"],
                )

    return assign


def _links(cosine: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """Counts and a spanning forest of the links of one block at home and one block of candidates."""
        homes, others = frame[frame["asks"]], frame[~frame["asks"]]
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if homes.empty or others.empty:
            return empty
        x, y = (np.array(f["vector"].tolist(), float) for f in (homes, others))
        product = unit(x) @ unit(y).T
        linked = product >= cosine
        for i, j in zip(*np.nonzero(np.abs(product - cosine) < 1e-12), strict=True):
            # Too near to tell by a sum whose order may change: exact sums decide.
            dot, one, two = (math.fsum(p * q) for p, q in ((x[i], y[j]), (x[i], x[i]), (y[j], y[j])))
            linked[i, j] = dot / math.sqrt(one * two) >= cosine
        a, b = homes["class"].to_numpy(), others["class"].to_numpy()
        linked &= a[:, None] != b[None, :]
        if not linked.any():
            return empty
        n = linked @ others["copies"].to_numpy()
        # The smallest class that links reach inside the block.
        low_a, low_b = a.copy(), b.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(low_a, np.where(linked, low_b[None, :], top).min(axis=1))
            new_b = np.minimum(low_b, np.where(linked, new_a[:, None], top).min(axis=0))
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        some_a, some_b = linked.any(axis=1), linked.any(axis=0)
        return pd.DataFrame(
            {
                "a": np.concatenate([a[some_a], b[some_b]]),
                "b": np.concatenate([low_a[some_a], low_b[some_b]]),
                "n": np.concatenate([n[some_a], np.zeros(some_b.sum(), np.int64)]),
            }
        )

    return compare


def near_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98
) -> DataFrame:
    """One row per row of `table`: (key, n_links, component_id, kept).

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least `cosine`; `n_links` counts a vector's direct
    links, `component_id` is the smallest key reachable, and that row is kept.

    Equal vectors are one class from the start. Spherical k-means gives cells;
    a vector is compared in its own cell and visits the others in which a
    linked one may be, so all links are found. A cell of any size is cut into
    blocks, and every pair of blocks is one group of bounded size, whose
    products are summed up: counts per vector and a spanning forest leave it,
    never the pairs.

    Vectors that are null, empty or zero, or hold null or non-finite components
    link with nothing, and neither do vectors of different lengths. Rows that
    repeat a key are vectors of their own; a null key is smaller than any other
    and its component is null. An empty table gives no rows; other columns are
    not read.
    """
    rows = table.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.coalesce(finite & F.exists("vector", lambda x: x != 0.0), F.lit(False))
    compared = F.col("label").isNotNull() & whole
    pool = F.concat_ws("/", F.size("vector"), "label")
    sound = rows.filter(compared).select("key", pool.alias("pool"), "vector")
    # Scale by a power of two, which is exact: no square over- or underflows, and the cosine stays.
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    sound = sound.withColumn("scale", F.pow(F.lit(2.0), F.floor(F.log2(peak))))
    sound = sound.withColumn("vector", F.transform("vector", lambda x: x / F.col("scale"))).drop("scale")
    classes = sound.groupBy("pool", "vector").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
    # A key that repeats with other vectors would name two classes: number them by key and place instead.
    heads = written(classes.withColumn("class_id", F.monotonically_increasing_id()))
    members = written(sound.join(heads, ["pool", "vector"]).select("key", "class_id", "copies"))
    n = heads.count()
    longest = heads.agg(F.max(F.size("vector"))).first()[0] or 0
    even = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector")))
    ready = heads.select(F.col("class_id").alias("class"), "copies", "pool", even.alias("vector"))
    centres = table.sparkSession.sparkContext.broadcast(fit_cells(ready, n))
    schema = "class long, copies long, pool string, vector array<double>, cell int, home boolean"
    assigned = written(ready.mapInArrow(_assigner(centres, cosine), schema))

    blocks = assigned.groupBy("pool", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("asking"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("asked")
    )
    dealt = assigned.join(blocks.filter("asking > 0"), ["pool", "cell"])
    up_to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    spread = F.xxhash64("class")
    columns = ["pool", "cell", "i", "j", "asks", "class", "copies", "vector"]
    asking = dealt.filter("home").select("*", F.pmod(spread, "asking").alias("i"), F.explode(up_to("asked")).alias("j"), F.lit(True).alias("asks"))
    asked = dealt.select("*", F.explode(up_to("asking")).alias("i"), F.pmod(spread, "asked").alias("j"), F.lit(False).alias("asks"))
    met = asking.select(*columns).unionByName(asked.select(*columns))
    met = met.withColumn("group", F.xxhash64("pool", "cell", "i", "j")).groupBy("group", "pool", "cell", "i", "j")
    links = written(met.applyInPandas(lambda frame: _links(cosine)(frame), "a long, b long, n long"))

    counts = links.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("linked"))
    grouped = components(links.filter("a <> b").select("a", "b"))
    placed = members.join(counts, "class_id", "left").join(grouped, members["class_id"] == grouped["node"], "left")
    placed = written(
        placed.select(
            "key",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component"),
        )
    )
    low = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    linked = placed.join(low, "component").select("key", "n_links", "component_id")
    alone = rows.filter(~compared).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    known = lambda c: F.when(F.col(c) != NO_KEY, F.col(c)).alias(key if c == "key" else c)
    return linked.unionByName(alone).select(
        known("key"), "n_links", known("component_id"), (F.col("key") == F.col("component_id")).alias("kept")
    )
