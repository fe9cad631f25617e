"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm import spans
from daypanel.llm.text import least_count, named, numbered_columns
from daypanel.llm.words import LONG_WORD, Encoder, encoder
from daypanel.sources.tables import written

#: Most words, and most bytes of them, in the table that is sent to all executors.
TABLE_WORDS, TABLE_BYTES = 1 << 18, 8 << 20


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every distinct word of all texts, of whatever script, and how often it occurs.

    Words of more than `words.LONG_WORD` bytes are left out. A task counts before any row leaves it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in spans.parts(batch.column(0)):
                low, starts, ends = spans.word_spans(*spans.buffers(part))
                short = ends - starts <= LONG_WORD
                found, inverse = spans.distinct(low, starts[short], ends[short])
                n = np.bincount(inverse, minlength=len(found))
                word = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([word, pa.array(n, pa.int64())], ["word", "n"])

    counted = docs.select(named(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, path: str, most: int = TABLE_WORDS, most_bytes: int = TABLE_BYTES) -> DataFrame:
    """(word, ids): the most frequent words, at most `most` of `most_bytes` in all, each encoded once.

    The least count that qualifies is the power of two that keeps them within
    both bounds; the words of equal class stay or go together.
    """
    least = least_count(counts, most, most_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoder(path).encode_word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return counts.filter(F.col("n") >= least).select("word").mapInArrow(encode, "word string, ids binary")


_given: dict = {}


def _encoder_with(table, path: str) -> Encoder:
    """One per worker and table."""
    if _given.get("id") != (table.value["id"], path):
        _given.update(id=(table.value["id"], path), encoder=Encoder(path, table.value["ids"]))
    return _given["encoder"]


def _encoding(columns: list[str], carried: list[str], text: str, ids: str, sent, path: str):
    """Batches of `columns` to batches of `carried` and the ids of `text`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in spans.parts(batch.column(columns.index(text))):
                flat, bounds = _encoder_with(sent, path).encode_batch(part)
                column = pa.Array.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(bounds * 4), pa.py_buffer(flat.astype("<u4"))]
                ).cast(pa.binary())
                others = [batch.column(columns.index(c)).slice(at, len(part)) for c in carried]
                yield pa.RecordBatch.from_arrays([*others, column], [*carried, ids])

    return encode


def pieces(path: str) -> pa.Array:
    """The vocabulary's id-to-piece table: the piece of id i at place i, null where there is none."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return pa.array(out, pa.string())


def _decoding(columns: list[str], ids: str, text: str, path: str):
    """Batches of `columns` to batches of them and the text of `ids`."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            for at, part in spans.parts(batch.column(columns.index(ids))):
                data, offsets = spans.buffers(part)
                flat = pa.array(np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
                known = pc.less(flat, len(table))
                found = table.take(pc.if_else(known, flat, pa.scalar(None, pa.int64())))
                bounds = offsets // 4
                if found.null_count:
                    valid = np.append(0, np.cumsum(found.is_valid().to_numpy(zero_copy_only=False)))
                    found, bounds = found.drop_null(), valid[bounds]
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), found)
                joined = pc.binary_join(lists, " ").cast(pa.string())
                others = [batch.column(columns.index(c)).slice(at, len(part)) for c in columns]
                yield pa.RecordBatch.from_arrays([*others, joined], [*columns, text])

    return decode


def _sent_table(docs: DataFrame, path: str, text: str, most: int):
    """The table of frequent words as a broadcast variable."""
    table = word_table(written(count_words(docs, text)), path, most).toPandas()
    ids = {word.encode(): bytes(x) for word, x in zip(table["word"], table["ids"], strict=True)}
    return docs.sparkSession.sparkContext.broadcast({"id": uuid.uuid4().hex, "ids": ids})


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", table_words: int = TABLE_WORDS) -> DataFrame:
    """`docs` with `ids`: the token ids of each whole text as little-endian unsigned 32-bit integers in a binary.

    Spark splits all texts into words and counts the distinct ones; the most
    frequent, `table_words` of `TABLE_BYTES` at most, are encoded once and sent
    to every executor. A task joins their ids to its words by position, and
    encodes those beyond the table itself, once while it remembers them: the
    documents need not move to meet the table. Words are told apart by their
    bytes, in texts of any script. The ids are those of the tokenizers library with no
    special tokens added, without truncation and padding; `path` names its file
    on every executor.

    Null counts as empty and gives no ids. An empty table gives no rows. All
    columns of `docs` stay; one named like `ids` is replaced.
    """
    kept = [c for c in docs.columns if c != ids]
    ordered = numbered_columns(docs, kept)
    at, names = f"c{kept.index(text)}", ordered.columns
    encode = _encoding(names, names, at, "ids", _sent_table(docs, path, text, table_words), path)
    return ordered.mapInArrow(encode, ordered.withColumn("ids", F.lit(b"")).schema).toDF(*kept, ids)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with `text`: what the library's decode gives for the ids, special tokens kept.

    The vocabulary has no decoder, so its pieces are set apart by a blank. Every
    task joins its ids to the table of pieces, whose size is the vocabulary's
    whatever the data's. Ids without a piece are left out, and a null or empty
    `ids` gives an empty text. All columns stay; one named like `text` is
    replaced.
    """
    kept = [c for c in encoded.columns if c != text]
    ordered = numbered_columns(encoded, kept)
    decode = _decoding(ordered.columns, f"c{kept.index(ids)}", "text", path)
    return ordered.mapInArrow(decode, ordered.withColumn("text", F.lit("")).schema).toDF(*kept, text)


def encode_and_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", table_words: int = TABLE_WORDS
) -> DataFrame:
    """`docs` without `text`, with its `ids` and their text `decoded`: both operators in one pass of one worker."""
    carried = [c for c in docs.columns if c not in (text, ids, decoded)]
    ordered = numbered_columns(docs, [*carried, text])
    names = ordered.columns[:-1]
    schema = ordered.select(*names, F.lit(b"").alias("ids"), F.lit("").alias("decoded")).schema
    encode = _encoding(ordered.columns, names, ordered.columns[-1], "ids", _sent_table(docs, path, text, table_words), path)
    decode = _decoding([*names, "ids"], "ids", "decoded", path)
    return ordered.mapInArrow(lambda batches: decode(encode(batches)), schema).toDF(*carried, ids, decoded)


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary file, for reports."""
    rows = [(i, p) for i, p in enumerate(pieces(path).to_pylist()) if p is not None]
    return spark.createDataFrame(rows, "id int, piece string")
