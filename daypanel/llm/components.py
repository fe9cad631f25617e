"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.sources.tables import written


def _least(edges: DataFrame, value: str, round_: int) -> DataFrame:
    """(node, best): of the values at a node's neighbours and its own, the one with the smallest hash."""
    return edges.groupBy("a").agg(F.min_by(value, F.xxhash64(F.lit(round_), value)).alias("best"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) of 64-bit numbers: the smallest node reachable.

    In each round every node takes the best node within two steps, by a hash
    that changes with the round, and the edges are drawn between what their ends
    took; a star of any size falls together at once and a chain loses a fixed
    share of its nodes. A node's neighbours are never collected: the best is an
    aggregate with map-side combine. Each round's tables are stored, so neither
    lineage nor the driver grows. Repeated edges and loops do no harm, and
    without edges there are no rows.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(ends.unionByName(ends.select("a", F.col("a").alias("b"))).distinct())
    moves, round_ = [], 0
    while not both.filter("a <> b").isEmpty():
        one = _least(both, "b", round_).select(F.col("a").alias("b"), F.col("best").alias("near"))
        move = written(_least(both.join(one, "b"), "near", round_).select(F.col("a").alias("node"), F.col("best").alias("to")))
        moves.append(move)
        from_a = move.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        from_b = move.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        drawn = both.join(from_a, "a").join(from_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        both = written(drawn.distinct())
        round_ += 1
    if not moves:
        loops = both.select(F.col("a").alias("node"), F.col("a").alias("component"))
        return loops.distinct()
    found = moves[0]
    for move in moves[1:]:
        further = move.select(F.col("node").alias("to"), F.col("to").alias("then"))
        found = found.join(further, "to").select("node", F.col("then").alias("to"))
    found = written(found)
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
