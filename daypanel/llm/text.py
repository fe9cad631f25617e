"""Text helpers of the corpus operators, in Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case and every other character as it is; null stays null.

    In a text of ASCII only that is `lower`, which is the faster one.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as c0, c1, ...: Spark's Python mappings look names up unquoted, so dots in them fail there."""
    return table.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])


def least_count(table: DataFrame, most_words: int, most_bytes: int) -> int:
    """The power of two such that the words of `table` (word, n) with as high an n keep within both bounds."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = table.groupBy(level).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    levels = {r["level"]: (r["words"], r["bytes"]) for r in sizes.collect()}
    least, words, size = 63, 0, 0
    while least > 0:
        more, larger = levels.get(least - 1, (0, 0))
        if words + more > most_words or size + larger > most_bytes:
            break
        least, words, size = least - 1, words + more, size + larger
    return 1 << least
