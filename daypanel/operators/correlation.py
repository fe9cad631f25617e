"""Pearson correlations of many columns, tile by tile.

The columns are cut into tiles, and the stored table has one array column per
tile. A stripe is one tile against itself and all later ones: it reads only
their columns, and a task that works on it holds one block of sums per tile it
meets, whatever the number of stripes. Pairs are summed once, for the upper
triangle; blocks of one pair of tiles are added up where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.sources.tables import written

#: Columns of a tile. A task holds six sums for each pair of a tile's columns with all columns.
TILE = 128
#: Rows whose products are taken at once.
ROWS_AT_ONCE = 2048


def correlation_long(df: DataFrame, cols: Sequence[str], tile: int = TILE) -> DataFrame:
    """(index, variable, value): Pearson correlation of every ordered pair of columns.

    A pair is taken over all rows in which both of its values are present and
    finite, whatever other columns lack. A column that is constant on the
    pair's rows has a null correlation. Only one sum and count per column
    reaches the driver.
    """
    tiles = _cut(cols, tile)
    if not tiles:
        return df.sparkSession.createDataFrame([], "index string, variable string, value double")
    pairs = len(tiles) * (len(tiles) + 1) // 2
    met = _stripe_rows(df, cols, tile).repartition(pairs, "i", "j")
    return met.mapInArrow(_correlations(tiles), "index string, variable string, value double")


def _cut(cols: Sequence[str], tile: int) -> list[list[str]]:
    return [list(cols[i : i + tile]) for i in range(0, len(cols), tile)]


def _stripe_rows(df: DataFrame, cols: Sequence[str], tile: int) -> DataFrame:
    """(i, j, sums): from each task of each stripe one block of sums per pair of tiles i <= j."""
    tiles = _cut(cols, tile)
    stored = written(df.select(*[_tile(names).alias(f"x{t}") for t, names in enumerate(tiles)]))
    middles = _middles(stored, tiles)
    later = lambda t: stored.select(*[f"x{u}" for u in range(t, len(tiles))])
    stripes = [later(t).mapInArrow(_stripe(t, middles), "i int, j int, sums binary") for t in range(len(tiles))]
    return reduce(DataFrame.unionAll, stripes)


def _tile(names: Sequence[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in names])


def _values(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, nan for null."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _middles(stored: DataFrame, tiles: list[list[str]]) -> list[np.ndarray]:
    """The mean of each column's finite values, 0 without any: sums about it keep the digits of values far from 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = ([np.zeros(len(names)) for names in tiles] for _ in range(2))
        for batch in batches:
            for t, names in enumerate(tiles):
                x = _values(batch.column(t), len(names))
                there = np.isfinite(x)
                n[t] += there.sum(axis=0)
                s[t] += np.where(there, x, 0.0).sum(axis=0)
        sizes = [len(names) for names in tiles]
        place = [pa.array(np.repeat(np.arange(len(tiles)), sizes), pa.int32()), pa.array(np.concatenate([np.arange(k) for k in sizes]), pa.int32())]
        yield pa.RecordBatch.from_arrays([*place, pa.array(np.concatenate(n)), pa.array(np.concatenate(s))], ["t", "c", "n", "s"])

    sums = stored.mapInArrow(add, "t int, c int, n double, s double").groupBy("t", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [np.zeros(len(names)) for names in tiles]
    for r in sums.collect():
        out[r["t"]][r["c"]] = r["s"] / r["n"] if r["n"] and np.isfinite(r["s"]) else 0.0
    return out


def _stripe(first: int, middles: list[np.ndarray]):
    """Batches of the tiles from `first` on to one row per tile: the sums of `first`'s columns with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                one = None
                for k in range(part.num_columns):
                    middle = middles[first + k]
                    x = _values(part.column(k), len(middle)) - middle
                    there = np.isfinite(x)
                    x, m = np.where(there, x, 0.0), there.astype(float)
                    one = (x, m, x * x) if one is None else one
                    (y, q, yy), (z, p, zz) = (x, m, x * x), one
                    block = np.stack([p.T @ q, z.T @ q, p.T @ y, zz.T @ q, p.T @ yy, z.T @ y])
                    sums[first + k] = sums[first + k] + block if first + k in sums else block
        if sums:
            rows = [b.tobytes() for b in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first] * len(sums), pa.int32()), pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], ["i", "j", "sums"]
            )

    return run


def _correlations(tiles: list[list[str]]):
    """Blocks of sums, one after the other, to the correlations of all pairs of tiles that this task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = np.frombuffer(sums.as_buffer(), float).reshape(6, len(tiles[i]), len(tiles[j]))
                whole[i, j] = whole[i, j] + block if (i, j) in whole else block
        for (i, j), (n, a, b, aa, bb, ab) in whole.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = (aa - a * a / n) * (bb - b * b / n)
                value = (ab - a * b / n) / np.sqrt(spread)
            known = (n > 1) & (spread > 0)
            row, column = np.nonzero(np.triu(np.ones(n.shape, bool), 1) if i == j else np.ones(n.shape, bool))
            values = pa.array(value[row, column], mask=~known[row, column])
            one, two = (pa.array(names, pa.string()).take(pa.array(at)) for names, at in ((tiles[i], row), (tiles[j], column)))
            for names in ([one, two], [two, one]):
                yield pa.RecordBatch.from_arrays([*names, values], ["index", "variable", "value"])

    return run
