"""Running sums, ranks and quantiles over a whole table, without a one-task window.

A table-wide ordered window would pass every row through one task. Here the
order column is cut into ranges of about equal weight: rows with the same
value are summed first, each range is then summed up by its own task, and the
totals of the ranges before it (one row per range) are added. Ties, however
heavy, are one row by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.sources.spine import hash_fraction


def range_edges(df: DataFrame, order: str, ranges: int) -> list[float]:
    """At most ranges + 1 edges that split the rows about evenly."""
    points = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(order).cast("double"), points, F.lit(ranges * 20)).alias("q")).first()
    inner = sorted(set(row["q"] or []))
    return [float("-inf"), *inner, float("inf")]


def default_ranges(df: DataFrame) -> int:
    """Ranges to use: one per shuffle partition, within reason."""
    return max(2, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_sums(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Per distinct value of `order` (within `by`), sums at, up to and overall.

    For each value `v` the result has `v` (sum at this order value), `cum_v`
    (sum up to and including it) and `all_v` (sum over everything in `by`).
    Rows whose order value is null are left out.
    """
    ranges = ranges or default_ranges(df)
    known = df.where(F.col(order).isNotNull())
    grouped = known.groupBy(*by, order).agg(*[F.sum(c).alias(v) for v, c in values.items()])
    edges = range_edges(known, order, ranges)
    placed = _place_in_ranges(grouped, order, edges)

    direction = F.col("_range").desc() if descending else F.col("_range")
    before = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy(*by)
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(v).over(overall).alias(f"all_{v}") for v in values],
    )

    inner_order = F.col(order).desc() if descending else F.col(order)
    within = (
        Window.partitionBy(*by, "_range").orderBy(inner_order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = placed.join(offsets, [*by, "_range"])
    return joined.select(
        *by,
        order,
        *values.keys(),
        *[(F.col(f"_before_{v}") + F.sum(v).over(within)).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )


def _place_in_ranges(df: DataFrame, order: str, edges: list[float]) -> DataFrame:
    if len(edges) < 3:
        return df.withColumn("_range", F.lit(0))
    keyed = df.withColumn("_key", F.col(order).cast("double"))
    cut = Bucketizer(splits=edges, inputCol="_key", outputCol="_range", handleInvalid="keep")
    return cut.transform(keyed).drop("_key").withColumn("_range", F.col("_range").cast("int"))


def hashed_row_numbers(
    df: DataFrame, id: str, seed: int, by: Sequence[str] = (), out: str = "rn", ranges: int | None = None
) -> DataFrame:
    """Add the 1-based place of each row in a pseudo-random order, within `by`.

    The order is a hash of the unique `id`, so it spreads evenly over fixed
    ranges whatever the data, and each range is numbered by its own task.
    """
    ranges = ranges or default_ranges(df)
    hashed = hash_fraction(F.col(id), seed)
    placed = df.withColumn("_order", hashed).withColumn("_range", F.floor(F.col("_order") * ranges).cast("int"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(
        *by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*by, "_range").orderBy("_order", id)
    numbered = placed.join(offsets, [*by, "_range"])
    return numbered.select(*df.columns, (F.col("_before") + F.row_number().over(within)).alias(out))


def shuffled_places(df: DataFrame, id: str, seed: int, files: int) -> DataFrame:
    """Add `file`, from 0 to files - 1, and `place` in it, gapless from 0: a shuffle that repeats.

    The order is that of a hash of the unique `id`, so the same rows get the
    same places however they were partitioned, and again after a lost task;
    files differ by one row at most.
    """
    total = max(df.count(), 1)
    # Whole-number division: a quotient of doubles may fall on the wrong side of a file's first row.
    file = F.expr(f"CAST((_rn - 1) * {files}L div {total}L AS INT)")
    first = F.expr(f"(file * {total}L + {files - 1}L) div {files}L")
    placed = hashed_row_numbers(df, id, seed, out="_rn").withColumn("file", file)
    return placed.withColumn("place", F.col("_rn") - 1 - first).drop("_rn")


def stored_in_order(df: DataFrame, order: Sequence[Column], path: str) -> DataFrame:
    """`df` sorted as a whole and stored at `path`, read back with `place`, its row number from 0.

    Spark deals the rows to files by ranges of the order; a row's place is that
    in its file behind the rows of the files before, one number per file. The
    places are those of any other partitioning if the order leaves no ties.
    """
    df.orderBy(*order).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("int")
    numbered = rows.select(
        "*", number(r"part-(\d+)").alias("_part"), number(r"-c(\d+)\.").alias("_piece"), F.col("_metadata.row_index").alias("_row")
    )
    before = Window.orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part", "_piece").agg(F.count("*").alias("_n"))
    # One row per file.
    offsets = sizes.select("_part", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.join(offsets, ["_part", "_piece"])
    return placed.select(*df.columns, (F.col("_before") + F.col("_row")).alias("place"))


def exact_quantiles(
    df: DataFrame, col: str, points: Sequence[float], by: Sequence[str] = (), interpolate: bool = True
) -> DataFrame:
    """(by, q, value): exact quantiles of a column of any size.

    With `interpolate` the value lies linearly between its two neighbours in
    the order, without it it is the smallest value that at least a share q of
    the rows do not exceed.
    """
    counts = running_sums(df, col, {"n": F.lit(1)}, by)
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in points])).alias("q")
    rows = counts.select(*by, F.col(col).alias("_v"), "n", "cum_n", "all_n", wanted)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    if not interpolate:
        place = F.greatest(F.ceil(F.col("q") * F.col("all_n")) - 1, F.lit(0))
        hit = rows.where(place.between(first, last))
        return hit.select(*by, "q", F.col("_v").cast("double").alias("value"))
    place = F.col("q") * (F.col("all_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    near = rows.where(low.between(first, last) | high.between(first, last))
    ends = near.groupBy(*by, "q").agg(
        F.min("_v").cast("double").alias("_low"),
        F.max("_v").cast("double").alias("_high"),
        F.max(place - low).alias("_part"),
    )
    return ends.select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))
