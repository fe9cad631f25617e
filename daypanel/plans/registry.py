"""Named queries over the given tables, each with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; `sql` computes the same rows elsewhere."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return register


def r(col, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            r(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
