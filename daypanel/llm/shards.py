"""Sharding: a Feistel permutation of global row numbers, in Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.text import named
from daypanel.sources.tables import written

ROUNDS = 6
WALKS = 32


def number_rows(df: DataFrame, buckets: int = 4096) -> tuple[DataFrame, int]:
    """Rows with `row_number`, gapless from 0, and how many there are.

    The number depends on the rows alone: they are ordered by a hash bucket of
    all columns and, in a bucket, by the columns. Rows equal in every column are
    counted before they move and numbered side by side, so one that repeats
    without end burdens no task. `buckets` bounds the table of offsets; a bucket
    holds a like share of the distinct rows and is sorted by one task, with
    spilling. Columns must be of types that can be grouped and ordered.
    """
    columns = df.columns
    n, at, bucket = "row_copies", "row_number", "row_bucket"
    cells = [named(c) for c in columns]
    counted = df.groupBy(*cells).agg(F.count(F.lit(1)).alias(n))
    # Stored: sizes and places read it, and the texts are hashed and moved once.
    counted = written(counted.withColumn(bucket, F.pmod(F.xxhash64(*cells), F.lit(buckets))))
    sizes = counted.groupBy(bucket).agg(F.sum(n).alias("bucket_rows"))
    total = sizes.agg(F.sum("bucket_rows")).first()[0] or 0
    # One row per bucket: a bounded table in one task.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(bucket, F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy(bucket).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn(at, F.coalesce(F.sum(n).over(within), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), bucket)
    # sequence() counts down if its end lies below its start; every count here is 1 or more.
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("row_copy")
    placed = placed.select(*cells, (F.col(at) + F.col("bucket_start")).alias(at), copies)
    return placed.select(*cells, (F.col(at) + F.col("row_copy")).alias(at)), total


def _digits(rows: int) -> tuple[int, int]:
    """Two bases whose product is at least `rows`, and less than two roots of it more."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _network(x: Column, rows: int, seed: int, back: bool = False) -> Column:
    """Feistel network with modular addition on the two digits of `x`."""
    a, b = _digits(rows)
    sign = -1 if back else 1

    def round_(acc: Column, j: Column) -> Column:
        odd = j % 2 == 1
        u, v = acc["u"], acc["v"]
        f = F.xxhash64(F.lit(seed), j, F.when(odd, v).otherwise(u))
        return F.struct(
            F.when(odd, F.pmod(u + sign * F.pmod(f, F.lit(a)), F.lit(a))).otherwise(u).alias("u"),
            F.when(odd, v).otherwise(F.pmod(v + sign * F.pmod(f, F.lit(b)), F.lit(b))).alias("v"),
        )

    order = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)
    return F.aggregate(
        F.array(*[F.lit(j) for j in order]),
        F.struct((x % a).alias("u"), F.floor(x / a).alias("v")),
        round_,
        lambda acc: acc["v"] * a + acc["u"],
    )


def permute(number: Column, rows: int, seed: int = 0, back: bool = False) -> Column:
    """The place of a row number among `rows` rows; `back=True` gives the row number of a place.

    A Feistel network permutes the numbers below a product of two bases, which
    exceeds `rows` by less than twice its root; a result of `rows` or more is
    permuted again (cycle walking) until it is below. `WALKS` repeats always
    suffice up to 250 rows, as no cycle can be longer, and beyond that all but
    once in 10**29 rows, which then fails loudly.
    """
    if rows >= 2**50:
        raise ValueError("more rows than a double division can number exactly")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        _network(number.cast("long"), rows, seed, back),
        lambda x, _: F.when(x < rows, x).otherwise(_network(x, rows, seed, back)),
    )
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Every row of `df` with its `shard` and its `slot` in that shard, gapless from 0.

    The rows are numbered (`number_rows`), the numbers permuted (`permute`), and
    place p goes to slot p // shards of shard p % shards: the shards are at most
    one row apart, whatever the row sizes and keys. The same rows and seed give
    the same places in any input order and partitioning. `row_number` stays, so
    that `permute(..., back=True)` finds the row of any shard and slot.

    Nulls are values like any other, repeated rows get places of their own, an
    empty table gives none, and all columns are kept; those named `shard`,
    `slot` or `row_*` are refused.
    """
    taken = {"shard", "slot", "row_number", "row_copies", "row_bucket", "row_copy", "bucket_start", "bucket_rows"}
    if taken & set(df.columns):
        raise ValueError(f"columns {sorted(taken & set(df.columns))} must be renamed first")
    numbered, rows = number_rows(df, buckets)
    place = numbered.withColumn("row_place", permute(F.col("row_number"), rows, seed))
    return place.select(
        *[named(c) for c in df.columns],
        "row_number",
        (F.col("row_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("row_place") / shards).cast("long").alias("slot"),
    )
