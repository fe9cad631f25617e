"""Hard negatives: exact search by inner product in which summaries of vector segments rule out rows before they are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.text import named
from daypanel.sources.tables import written

#: Segments of the finest summaries; each coarser level has half as many, down to one.
SEGMENTS = 16
#: Rows of a block and anchors of a block; every pair of blocks is a group of bounded size.
BLOCK, ANCHORS = 2048, 16384
#: Rows and anchors of a block that are compared at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 1024, 64
#: Pools, of one length or one length and label, whose numbers of blocks are broadcast; more of them are joined.
POOLS = 1 << 16
NO_SCORE = np.iinfo(np.int64).min

SUMMARY = "row long, key long, label string, size int, anchor boolean, x array<long>, means array<double>, deviations array<double>"
FOUND = "anchor long, place int, anchor_key long, given_key long, given_score long, key long, row long, score long"


def segments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of the `SEGMENTS` segments of each row of x, which zeros fill up to whole segments."""
    parts = fill_up(x).reshape(len(x), SEGMENTS, -1).astype(float)
    return parts.mean(axis=2), parts.std(axis=2)


def fill_up(x: np.ndarray) -> np.ndarray:
    wide = max(1, -(-x.shape[1] // SEGMENTS)) * SEGMENTS
    return np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def coarser(means: np.ndarray, deviations: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of n segments from those of a multiple of n."""
    m, s = (v.reshape(len(v), n, -1) for v in (means, deviations))
    whole = m.mean(axis=2)
    return whole, np.sqrt((s * s + (m - whole[:, :, None]) ** 2).mean(axis=2))


def summarise(rows: DataFrame) -> DataFrame:
    """Of (row, key, label, size, anchor, x): the same with mean and deviation of each segment of x."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = np.array(part.column(5).flatten(), np.int64).reshape(part.num_rows, size)
                means, deviations = segments(x)
                as_list = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), SEGMENTS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, as_list(means), as_list(deviations)],
                    ["row", "key", "label", "size", "anchor", "x", "means", "deviations"],
                )

    return rows.select("row", "key", "label", "size", "anchor", "x").mapInArrow(read, SUMMARY)


class Side:
    """The vectors of one side of a block pair with their summaries at every level, finest last."""

    def __init__(self, frame: pd.DataFrame, labels: np.ndarray):
        self.rows = frame["row"].to_numpy(np.int64)
        self.keys = frame["key"].to_numpy(np.int64)
        self.labels = labels
        self.x = fill_up(np.stack(frame["x"].to_numpy()).astype(np.int64).reshape(len(frame), -1))
        means, deviations = (np.stack(frame[c].to_numpy()) for c in ("means", "deviations"))
        counts = [1 << i for i in range(SEGMENTS.bit_length())]
        self.levels = [coarser(means, deviations, n) for n in counts]
        self.norms = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))


def _best(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each group, by falling score and rising key; groups in order."""
    order = np.lexsort((key, -score, group))
    ordered = group[order]
    first = np.ones(len(order), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(first)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < k]


def search(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, k: int, alike: bool) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score) by index: the first k rows of each anchor's windows, scores from `low` to `high`.

    Only rows of the anchor's label take part if `alike`, else only those of
    others. For a segment of length L the products of two vectors sum up to
    L (m m' +- s s'), m and s their mean and deviation in it. Pairs whose bounds
    miss every window, or the k best already found in it, go at one segment; the
    others meet ever finer segments, and only what is left is scored.
    """
    if anchors.norms.max() * rows.norms.max() >= 2.0**62:
        raise OverflowError("scores may not fit into 64 bits")
    windows = low.shape[1]
    length = [anchors.x.shape[1] // m.shape[1] for m, _ in anchors.levels]
    kept = [np.zeros(0, np.int64)] * 4
    for a0 in range(0, len(anchors.rows), ANCHORS_AT_ONCE):
        some = slice(a0, min(a0 + ANCHORS_AT_ONCE, len(anchors.rows)))
        least, most = low[some].copy(), high[some]
        found = [np.zeros(0, np.int64)] * 3
        for r0 in range(0, len(rows.rows), ROWS_AT_ONCE):
            near = slice(r0, min(r0 + ROWS_AT_ONCE, len(rows.rows)))
            slack = 1e-9 * anchors.norms[some][:, None] * rows.norms[near][None, :] + 1e-6
            open_ = (rows.labels[near][None, :] == anchors.labels[some][:, None]) == alike
            open_ &= rows.rows[near][None, :] != anchors.rows[some][:, None]
            (m, s), (p, t) = anchors.levels[0], rows.levels[0]
            middle, width = length[0] * (m[some] @ p[near].T), length[0] * (s[some] @ t[near].T) + slack
            i, j = np.nonzero(open_ & _reaches(middle[..., None], width[..., None], least[:, None, :], most[:, None, :]))
            slack = slack[i, j]
            for (m, s), (p, t), size in zip(anchors.levels[1:], rows.levels[1:], length[1:], strict=True):
                if not len(i):
                    break
                middle = size * np.einsum("ps,ps->p", m[a0 + i], p[r0 + j])
                width = size * np.einsum("ps,ps->p", s[a0 + i], t[r0 + j]) + slack
                left = _reaches(middle[:, None], width[:, None], least[i], most[i])
                i, j, slack = i[left], j[left], slack[left]
            if not len(i):
                continue
            score = np.einsum("pd,pd->p", anchors.x[a0 + i], rows.x[r0 + j])
            inside = (score[:, None] >= least[i]) & (score[:, None] <= most[i])
            pair, window = np.nonzero(inside)
            fresh = (i[pair] * windows + window, j[pair] + r0, score[pair])
            group, row, score = (np.concatenate([one, two]) for one, two in zip(found, fresh, strict=True))
            best = _best(group, score, rows.keys[row], k)
            found = [group[best], row[best], score[best]]
            # A window with k rows needs no lower score any more, equal ones may have a smaller key.
            full = np.bincount(found[0], minlength=least.size) == k
            worst = np.full(least.size, np.iinfo(np.int64).max)
            np.minimum.at(worst, found[0], found[2])
            flat = least.reshape(-1)
            flat[full] = np.maximum(flat[full], worst[full])
        group, row, score = found
        kept = [np.concatenate(x) for x in zip(kept, (group // windows + a0, group % windows, row, score), strict=True)]
    return tuple(kept)


def _reaches(middle: np.ndarray, width: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether any window may hold a score within `width` of `middle`; windows lie on the last axis."""
    return ((middle + width >= least) & (middle - width <= most) & (least <= most)).any(axis=-1)


def _searched(k: int, alike: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asking, asked = frame[frame["asks"]], frame[~frame["asks"]]
        if asking.empty or asked.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")}).astype({"place": "int32"})
        codes = pd.factorize(frame["label"])[0]
        windows = max(len(x) for x in asking["given"])
        low, high = (np.full((len(asking), windows), fill, np.int64) for fill in (1, 0))
        given = np.zeros((2, len(asking), windows), np.int64)
        for n, held in enumerate(asking["given"]):
            for w, g in enumerate(held):
                low[n, w], high[n, w], given[0, n, w], given[1, n, w] = g["low"], g["high"], g["key"], g["score"]
        one, two = Side(asking, codes[frame["asks"].to_numpy()]), Side(asked, codes[~frame["asks"].to_numpy()])
        a, w, r, score = search(one, two, low, high, k, alike)
        return pd.DataFrame(
            {
                "anchor": one.rows[a],
                "place": w.astype(np.int32),
                "anchor_key": one.keys[a],
                "given_key": given[0, a, w],
                "given_score": given[1, a, w],
                "key": two.keys[r],
                "row": two.rows[r],
                "score": score,
            }
        )

    return run


def _first(anchors: DataFrame, rows: DataFrame, pool: list[str], k: int, alike: bool, block: int, many: int) -> DataFrame:
    """(anchor, place, ..., rank): for each window of each anchor its first k rows, from all pairs of blocks of a pool."""
    up_to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    asked = rows.groupBy(*pool).agg(F.ceil(F.count(F.lit(1)) / block).alias("asked"))
    asking = anchors.groupBy(*pool).agg(F.ceil(F.count(F.lit(1)) / many).alias("asking"))
    blocks = written(asked.join(asking, pool))
    if blocks.limit(POOLS + 1).count() <= POOLS:
        blocks = F.broadcast(blocks)
    spread = F.xxhash64("row")
    columns = ["pool", "i", "j", "asks", "row", "key", "label", "x", "means", "deviations", "given"]
    dealt = anchors.join(blocks, pool).withColumn("pool", F.concat_ws("/", *pool))
    one = dealt.select("*", F.pmod(spread, "asking").alias("i"), F.explode(up_to("asked")).alias("j"), F.lit(True).alias("asks"))
    dealt = rows.join(blocks, pool).withColumn("pool", F.concat_ws("/", *pool))
    none = F.lit(None).cast(anchors.schema["given"].dataType)
    two = dealt.select("*", F.explode(up_to("asking")).alias("i"), F.pmod(spread, "asked").alias("j"), F.lit(False).alias("asks"), none.alias("given"))
    met = one.select(*columns).unionByName(two.select(*columns))
    run = _searched(k, alike)
    found = met.groupBy("pool", "i", "j").applyInPandas(lambda frame: run(frame), FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "key", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(
    table: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = BLOCK,
    many: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `table` where `anchors` holds.

    `vector` has whole numbers; a row's score is its inner product with the
    anchor, higher ones come first, equal ones by smaller key. An anchor's
    positives are its first `positives` other rows of its label. For each, its
    negatives are the first `negatives` rows of other labels whose score is
    `low` to `high` per cent of the positive's, both ends included.

    The mean and deviation of each vector's segments are stored beside it. Rows
    and anchors are dealt to blocks by a hash, of one label for the positives and
    of all for the negatives, and each pair of blocks is one group of at most
    some `block` rows and `many` anchors, whatever the size of a label or a group
    of copies. In it bounds by ever finer segments rule pairs out, and the rest
    are scored; all results are exact. Only each group's first rows leave it.

    Rows with a null key or label, or a vector that is null or holds a null, take
    no part; nor do vectors of different lengths meet. Rows that repeat a key
    are rows of their own, as anchors too. Vectors so long that scores may need more
    than 62 bits raise an error.
    An empty table, or one without anchors, gives no rows; columns of other
    names are not read.
    """
    rows = table.select(
        F.monotonically_increasing_id().alias("row"),
        named(key).cast("long").alias("key"),
        named(label).cast("string").alias("label"),
        F.size(named(vector)).alias("size"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        named(vector).cast("array<long>").alias("x"),
    )
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    # Stored, so that the numbers of the rows stay.
    known = written(summarise(rows.filter(sound)))
    asking = known.filter("anchor")
    # One window, without ends, for the positives.
    ends = [F.lit(v).cast("long").alias(c) for c, v in (("low", NO_SCORE + 1), ("high", np.iinfo(np.int64).max), ("key", 0), ("score", 0))]
    alike = _first(asking.withColumn("given", F.array(F.struct(*ends))), known, ["size", "label"], positives, True, block, many)
    # Whole numbers n with low * p <= 100 n <= high * p.
    from_ = F.ceil(F.col("score") * F.lit(low).cast("decimal(4,0)") / F.lit(100)).cast("long")
    to = F.floor(F.col("score") * F.lit(high).cast("decimal(4,0)") / F.lit(100)).cast("long")
    given = F.struct("rank", from_.alias("low"), to.alias("high"), "key", "score")
    windows = alike.groupBy("anchor").agg(F.sort_array(F.collect_list(given)).alias("given"))
    windows = written(windows.withColumn("given", F.transform("given", lambda g: g.dropFields("rank"))))
    asking = asking.join(windows.withColumnRenamed("anchor", "row"), "row")
    other = _first(asking, known, ["size"], negatives, False, block, many)
    return other.select(
        F.col("anchor_key").alias("anchor_id"),
        F.col("given_key").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("key").alias("negative_id"),
        F.col("given_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
