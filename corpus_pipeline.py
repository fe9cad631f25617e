"""From raw documents to packed sequences: four stages, each stored before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm import jaccard, language, lines, packing
from daypanel.llm.queries import vocabulary
from daypanel.sources.tables import load, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, where: str) -> DataFrame:
    """Documents in some language, with the predicted one as `lang` where it is null; what has no letter at all goes.

    The model learns from the documents' own labels; without labels, nothing is
    identified and only letters decide. Null and empty texts go, very long ones
    are read whole, repeated rows and null ids stay, an empty table gives no
    rows. The five columns of documents are returned, here as in the next stages.
    """
    model = language.fit(docs)
    if not model["languages"]:
        return docs.filter(language.has_letter(F.col("text"))).select(*COLUMNS)
    found = language.identify(docs, model)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, where: str) -> DataFrame:
    """Documents without the passages and chunks of lines that an earlier document has; `n_chars` follows a changed text.

    A null text stays as it is, a text of nothing but repeated lines becomes
    empty, rows that repeat id and text are one document; an empty table gives
    no rows.
    """
    cleaned = lines.drop_repeated_passages(docs)
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, where: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, a null one being smaller than any other.

    Documents link by their whole texts alone, so rows of a null or repeated id
    fall together only where their texts do; null texts and texts without words
    all stay. An empty table gives no rows.
    """
    return jaccard.keep_first(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, where: str) -> DataFrame:
    """Every token of every document in sequences of at most 4096, one row per piece.

    A null or empty text is its end token, a long one several pieces; repeated
    rows are packed as often as they occur, and an empty table gives no rows.
    """
    packed = packing.pack_documents(docs, vocabulary(), end_id=2, size=4096, ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

# The last stage needs the tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, where: str) -> DataFrame:
    """All stages over the whole table `documents`."""
    docs = load(spark, where, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, where))
    return STAGES[-1][1](spark, docs, where)
