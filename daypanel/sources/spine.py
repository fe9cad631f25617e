"""Date spine, entity sampling and deterministic splits."""

from __future__ import annotations

from datetime import date as Date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_date(value: str | Date) -> Column:
    return F.lit(value if isinstance(value, Date) else Date.fromisoformat(value))


def day_count(start: str, end: str) -> int:
    """Days from `start` to `end`, both included."""
    return (Date.fromisoformat(end) - Date.fromisoformat(start)).days + 1


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(as_date(start), as_date(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def hash_fraction(key: Column, seed: int) -> Column:
    """A uniform value in [0, 1) that depends on the key and seed only.

    md5 rather than a Spark-private hash, so that any engine can redraw the
    same sample.
    """
    digest = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def entity_sample(df: DataFrame, id: str, fraction: float, seed: int = 42) -> DataFrame:
    """Keep the full history of a pseudo-random share of the entities.

    The decision is a function of the id, so it needs no distinct, no join and
    no caching, and a recomputed task draws the same entities again.
    """
    if fraction >= 1.0:
        return df
    return df.where(hash_fraction(F.col(id), seed) < fraction)


DEFAULT_SPLIT = {"train": 14, "val": 18, "test": 20}
TWO_WAY_SPLIT = {"train": 14, "test": 20}


def split_by_mod(df: DataFrame, id: str, mod: int = 20, bounds: dict[str, int] = DEFAULT_SPLIT) -> DataFrame:
    """Add `split`: the first bound above id modulo `mod`."""
    bucket = F.pmod(F.col(id), F.lit(mod))
    names = sorted(bounds, key=bounds.get)
    label = reduce(
        lambda later, name: F.when(bucket < bounds[name], name).otherwise(later),
        reversed(names),
        F.lit(None).cast("string"),
    )
    return df.withColumn("split", label)


def in_split(df: DataFrame, id: str, lo: int, hi: int, mod: int = 20) -> DataFrame:
    """Rows whose id modulo `mod` lies in [lo, hi)."""
    bucket = F.pmod(F.col(id), F.lit(mod))
    return df.where((bucket >= lo) & (bucket < hi))
