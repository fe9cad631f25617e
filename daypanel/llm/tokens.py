"""Token counts: the pieces of each distinct pre-token counted once, joined to how often a document has it."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.text import least_count, named
from daypanel.sources.tables import written

#: Most pre-tokens, and most bytes of them, in the table that is sent to all executors.
TABLE_WORDS, TABLE_BYTES = 1 << 18, 16 << 20
#: Distinct pre-tokens that a task gathers before it hands their counts on.
GATHERED = 300_000
#: Characters that are cut at once.
SEGMENT = 1 << 20
#: What a blank becomes before the merges, U+2581.
BLANK = "▁"


class Cutter:
    """Cuts texts into pre-tokens over whose edges no piece of a sentencepiece BPE model reaches, and counts pieces.

    Merges only join neighbours into what is a piece, so where no piece holds two
    characters side by side a text falls into parts that are encoded alone. A
    character of no piece, which becomes bytes, is a part of its own.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        # Models that fold characters or drop blanks would not fall apart at the same places.
        probe = "ﬁ  ① é A x "
        shown = self.model.normalize(probe)
        if shown.removeprefix(BLANK) != probe.replace(" ", BLANK):
            raise ValueError("the model's normaliser changes more than blanks")
        self.prefix = BLANK if shown.startswith(BLANK) else ""
        size = self.model.get_piece_size()
        real = [
            self.model.id_to_piece(i)
            for i in range(size)
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        pairs = {p[i : i + 2] for p in real for i in range(len(p) - 1)}
        inside = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for one, two in pairs:
            self.joined[self.number[ord(one)], self.number[ord(two)]] = True
        # A character of no piece keeps the blank that the model puts before a text away from the pre-token.
        used = {c for p in real for c in p}
        self.guard = next(chr(c) for c in range(1, 0x110000) if chr(c) not in used)
        self.guarded = len(self.model.encode(self.guard))

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; their pieces in a row are the text's."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", BLANK)
        words, held = [], ""
        for at in range(0, len(text), SEGMENT):
            held += text[at : at + SEGMENT]
            known = self.number[np.frombuffer(held.encode("utf-32-le"), "<u4")]
            cuts = (np.flatnonzero(~self.joined[known[:-1], known[1:]]) + 1).tolist()
            if cuts:
                words += [held[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
                held = held[cuts[-1] :]
        return [*words, held]

    def pieces(self, word: str) -> int:
        return len(self.model.encode(self.guard + word)) - self.guarded


@functools.cache
def cutter(path: str) -> Cutter:
    """One per worker process and model."""
    return Cutter(path)


def pretoken_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): every distinct pre-token of all texts and how often it occurs; a task counts before any row leaves it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                found.update(cutter(path).cut(value.as_py() or ""))
                if len(found) > GATHERED:
                    yield rows()
        yield rows()

    return docs.select(named(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """`counts` with `pieces`: into how many pieces each distinct pre-token falls, encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [cutter(path).pieces(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["word", "n", "pieces"])

    return counts.select("word", "n").mapInArrow(encode, "word string, n long, pieces long")


def count_tokens(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
    table_words: int = TABLE_WORDS,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per row of `docs`: (key, n_bytes, n_tokens, over_limit), tokens as the sentencepiece model at `path` gives them.

    Texts are cut into pre-tokens that no piece reaches across; each distinct one
    is encoded once, and a document's count is the sum over its pre-tokens of how
    often it has them times their pieces. No ids are kept. The join has two
    parts: the most frequent pre-tokens, at most `table_words` of `table_bytes`,
    go to every executor and are summed where the documents are; (row, pre-token,
    times) of all others meet their counts in a shuffle. Any bounds give the same
    counts. No begin, end or other special token is added, and their strings in a
    text are ordinary text.

    A null or empty text has 0 bytes and tokens; `key` may be null or repeat, each
    row is counted alone; other columns are not read. An empty table gives no
    rows. A very long text is cut a million characters at a time by one task,
    which holds it, its distinct pre-tokens and their counts.
    """
    counted = written(piece_counts(pretoken_counts(docs, path, text), path))
    least = least_count(counted, table_words, table_bytes)
    frequent = counted.filter(F.col("n") >= least).select("word", "pieces").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["word"], frequent["pieces"], strict=True)))

    def sum_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            known, words, times, bounds = [], [], [], [0]
            for value in batch.column(1):
                total = 0
                for word, n in Counter(cutter(path).cut(value.as_py() or "")).items():
                    each = pieces.get(word)
                    if each is None:
                        words.append(word)
                        times.append(n)
                    else:
                        total += n * each
                known.append(total)
                bounds.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(known, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words, pa.string())),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times, pa.int64())),
                ],
                ["row", "known", "words", "times"],
            )

    # The rows are numbered once and stored, so that each later reading finds the same numbers.
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("id"), named(key).alias("key"), F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), named(text).alias("text"))
    schema = rows.select("row", F.lit(0).cast("long").alias("known"), F.array(F.lit("")).alias("words"), F.array(F.lit(0).cast("long")).alias("times")).schema
    summed = written(rows.mapInArrow(sum_known, schema))

    rest = counted.filter(F.col("n") < least).select("word", "pieces")
    met = summed.select(F.col("row.id").alias("id"), F.explode(F.arrays_zip("words", "times")).alias("has")).select("id", "has.words", "has.times")
    others = met.join(rest, met["words"] == rest["word"]).groupBy("id").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    n_tokens = F.col("known") + F.coalesce("others", F.lit(0).cast("long"))
    out = summed.select("row.id", "row.key", "row.n_bytes", "known").join(others, "id", "left")
    return out.select(F.col("key").alias(key), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
