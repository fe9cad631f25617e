"""Exact duplicates by recipes of content-defined chunks, in Spark expressions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.text import lower_ascii, named
from daypanel.sources.tables import written

# A chunk ends at the first line or sentence end after 512 characters, or at 8,192.
CHUNK = r"(?s).{512,8192}?(?:\n|\. )|.{1,8192}"


def chunks_of(text: Column) -> Column:
    """Content-defined chunks of a text in order; they concatenate to it, and an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, seed: int) -> Column:
    """128 bits of a chunk."""
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("a"), F.xxhash64(F.lit(~seed), chunk).alias("b"))


def verified_seed(chunks: DataFrame, chunk: str = "chunk") -> int:
    """A seed under which no two different chunks share an identifier, by their bytes.

    Equal chunks meet in one group and are dropped on the map side first, so a
    chunk that a third of all documents hold moves once per task. The seed is 0
    but once in some 10**14 corpora of 10**12 chunks.
    """
    for seed in count():
        identified = chunks.select(_identifier(F.col(chunk), seed).alias("id"), chunk).distinct()
        clash = identified.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if clash.isEmpty():
            return seed


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Each is cut into chunks where its content says so. The chunks' bytes move
    once, to verify that their identifiers tell them apart (`verified_seed`);
    then only the ordered identifier lists are grouped, so no document moves
    whole. `text_sha256` is of the normalised text in UTF-8.

    The row with the largest key of a group stays; a null key is smaller than any
    other. Of rows that repeat both key and text, one stays. An empty table gives
    no rows; other columns of `docs`, whatever their names, are not read.
    """
    normal = docs.select(
        named(key).alias("key"), lower_ascii(F.coalesce(named(text), F.lit(""))).alias("normal")
    )
    seed = verified_seed(normal.select(F.explode(chunks_of(F.col("normal"))).alias("chunk")))
    recipes = written(
        normal.select(
            "key",
            F.sha2(F.col("normal").cast("binary"), 256).alias("sha"),
            F.transform(chunks_of(F.col("normal")), lambda c: _identifier(c, seed)).alias("recipe"),
        )
        .groupBy("key", "recipe")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("sha").alias("sha"))
    )
    groups = recipes.groupBy("recipe").agg(F.max("key").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Stored, so that the join deals both sides anew and can split a large group.
    groups = written(groups.filter("group_size > 1"))
    joined = recipes.join(groups, "recipe", "left").withColumns(
        {"keep_id": F.coalesce("keep_id", "key"), "group_size": F.coalesce("group_size", F.lit(1))}
    )
    # One copy of each row beyond the first: repeats of a whole row are told apart by number.
    rows = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that `find_copies` keeps, with all their columns.

    Rows are matched by key and text, and one of several rows that repeat both
    stays, whichever it is. Null and empty texts are equal, a null key is one
    too; an empty table gives no rows, and a very long text is hashed where it
    is. Columns may have any names.
    """
    found = find_copies(docs, key, text).filter("kept")
    kept = found.select(named(key).alias("kept_key"), F.col("text_sha256").alias("kept_sha"))
    sha = F.sha2(lower_ascii(F.coalesce(named(text), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(key).alias("key"), sha.alias("sha"))
    same = F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("sha") == F.col("kept_sha"))
    single = rows.join(kept, same, "left_semi").dropDuplicates(["key", "sha"])
    return single.select(*[F.col("row")[c].alias(c) for c in docs.columns])
