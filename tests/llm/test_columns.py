"""Columns of any name stay; passages of any form go; long conversations are read in linear time."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from daypanel.llm import bpe, chat, exact, jaccard, language, lines, packing, shards
from daypanel.llm.queries import op6_line_dedup  # noqa: F401  the operator tested here is what the query applies

NAMES = ["a.b", "text_sha256", "kept_key", "row", "place", "key", "print", "copies", "unit", "at", "id", "two words"]


@pytest.fixture(scope="module")
def many_columns(spark):
    texts = ["The cat and the dog are here.", None, "", "The cat and the dog are here.", "the CAT and the dog are here.", "line one\nline two"]
    rows = [(i, t, *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES])


def kept_whole(before, after):
    """The rows of `after` have the values that their id had in `before`, in all columns but the text."""
    old = {r["doc_id"]: r for r in before.collect()}
    rows = after.collect()
    assert rows
    for r in rows:
        assert all(r[n] == old[r["doc_id"]][n] for n in NAMES)
    return sorted(r["doc_id"] for r in rows)


def test_names_that_operators_use_or_must_quote(spark, many_columns, vocabulary):
    df = many_columns
    everyone = list(range(6))
    assert kept_whole(df, lines.drop_repeated_chunks(df)) == everyone
    assert kept_whole(df, lines.drop_repeated_passages(df)) == everyone
    assert kept_whole(df, jaccard.keep_first(df)) == [0, 1, 2, 5]
    assert kept_whole(df, exact.drop_copies(df)) == [2, 4, 5]
    assert kept_whole(df, bpe.encode_texts(df, vocabulary)) == everyone
    assert kept_whole(df, bpe.decode_ids(bpe.encode_texts(df, vocabulary), vocabulary)) == everyone
    assert kept_whole(df, bpe.encode_and_decode(df, vocabulary)) == everyone
    assert kept_whole(df, shards.shard_rows(df, 3)) == everyone
    model = language.fit(df.withColumn("lang", F.lit("en")), order="a.b")
    assert kept_whole(df, language.identify(df, model)) == everyone
    pieces = df.withColumn("length", F.lit(3))
    assert kept_whole(df, packing.pack(pieces, 10, order=("doc_id",))) == everyone


def test_operators_read_columns_of_any_name(spark, many_columns, vocabulary):
    df = many_columns.select(F.col("doc_id").alias("x.y"), F.col("text").alias("t z"))
    found = exact.find_copies(df, "x.y", "t z")
    assert found.count() == 6 and found.columns[0] == "x.y"
    assert exact.drop_copies(df, "x.y", "t z").count() == 3
    assert jaccard.keep_first(df, "x.y", "t z").count() == 4
    assert lines.drop_repeated_passages(df, "x.y", "t z").columns == ["x.y", "t z", "lines_total", "lines_removed"]
    assert packing.pack_documents(df, vocabulary, key="x.y", text="t z").count() == 6
    assert bpe.encode_texts(df, vocabulary, "t z").count() == 6


@pytest.mark.parametrize(("n", "words"), [(2, 30), (2, 45), (3, 25), (4, 20), (5, 15), (8, 12), (12, 6), (1, 60)])
def test_every_repeated_passage_goes(spark, n, words):
    """Each passage stands in two documents between lines of their own; only in the second it goes, and nothing else does."""
    draw = random.Random(n * 100 + words)
    own = lambda k: [" ".join(f"o{draw.randrange(10**9)}" for _ in range(draw.randrange(3, 15))) for _ in range(k)]
    rows, expected = [], {}
    for p in range(60):
        passage = [" ".join(f"p{draw.randrange(10**9)}" for _ in range(words)) for _ in range(n)]
        for side in (0, 1):
            head, tail = own(draw.randrange(0, 6)), own(draw.randrange(1, 6))
            rows.append((p + 1000 * side, "\n".join([*head, *passage, *tail])))
            expected[p + 1000 * side] = "\n".join([*head, *([] if side else passage), *tail])
    got = lines.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == expected


def test_reading_a_conversation_is_linear(spark):
    n = 100_000
    turns = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é<|im_end|>&"), F.col("id").cast("string"), F.repeat(F.lit("𝔘x"), 55)).alias("text"),
    )
    start = time.time()
    row = chat.read_conversations(chat.format_conversations(turns)).select(
        F.size("turns").alias("n"), F.sha2(F.array_join("loss_texts", ""), 256).alias("loss")
    ).first()
    assert time.time() - start < 60
    said = "".join(f"é<|im_end|>&{i}" + "𝔘x" * 55 for i in range(1, n, 2))
    assert (row["n"], row["loss"]) == (n, hashlib.sha256(said.encode()).hexdigest())
