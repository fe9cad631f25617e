"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm import spans
from daypanel.llm.text import named, numbered_columns
from daypanel.llm.words import encoder
from daypanel.sources.tables import written

#: Pieces that one task packs together; the padding of a group is about one sequence.
GROUP = 16_384


def tokenize(docs: DataFrame, path: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `size` tokens: (key, start, length, doc_tokens, ids_crc32, ids).

    A document's tokens are those of its whole text (null: none) and `end_id`
    behind them. It is cut after every `size` tokens, so all its pieces but the
    last fill a sequence by themselves. `ids` are little-endian unsigned 32-bit
    integers, `ids_crc32` is their checksum.
    """
    schema = "key long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in spans.parts(batch.column(1)):
                flat, bounds = encoder(path).encode_batch(part)
                rows: list[list] = [[], [], [], [], [], []]
                for i, k in enumerate(batch.column(0).slice(at, len(part)).to_pylist()):
                    ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size].tobytes()
                        for column, value in zip(
                            rows, (k, start, len(piece) // 4, len(ids), zlib.crc32(piece), piece), strict=True
                        ):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)],
                    ["key", "start", "length", "doc_tokens", "ids_crc32", "ids"],
                )

    pieces = docs.select(named(key).cast("long").alias("key"), named(text).alias("text")).mapInArrow(cut, schema)
    return pieces.withColumnRenamed("key", key)


class Bins:
    """Bins in order of opening; a tournament tree holds the larger room of each two."""

    def __init__(self, most: int, size: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """The first bin with room for `length`, which it takes."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bin_ = node - self.leaves
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return bin_


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; equal lengths in their given order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = Bins(len(lengths), size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        bins[i] = tree.first_fit(length)
        offsets[i] = size - tree.room[tree.leaves + bins[i]] - length
    return bins, offsets


def pack(pieces: DataFrame, size: int, length: str = "length", order: tuple[str, ...] = (), group: int = GROUP, seed: int = 0) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: gapless in each sequence, at most `size` in all.

    Pieces are dealt at random, by a generator seeded with `seed`, to groups of
    about `group`, which no key or length can make uneven; every group is packed
    by itself, first-fit decreasing. A group leaves less than one sequence of
    padding beyond what the lengths themselves force. `order` names columns that
    decide among equal lengths. Lengths must lie between 1 and `size`; an empty
    table gives no rows, and all columns stay but for those named `sequence_id`,
    `offset` or `pack_group`, which are replaced.

    `pieces` must be a stored table (`written`): the dealing repeats with its rows.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "pack_group")]
    groups = max(1, -(-pieces.count() // group))
    own = numbered_columns(pieces, kept)
    names, at = own.columns, f"c{kept.index(length)}"
    by = [f"c{kept.index(c)}" for c in order]
    dealt = own.select("*", F.floor(F.rand(seed) * groups).cast("long").alias("pack_group"))
    schema = own.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(by, kind="stable") if by else frame
        lengths = frame[at].to_numpy()
        if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= size:
            raise ValueError(f"lengths must lie between 1 and {size}")
        bins, offsets = first_fit_decreasing(lengths, size)
        out = frame[names].copy()
        out["sequence_id"] = frame["pack_group"].to_numpy() * (1 << 32) + bins
        out["offset"] = offsets
        return out

    return dealt.groupBy("pack_group").applyInPandas(fill, schema).toDF(*kept, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, key: str = "doc_id", text: str = "text", ids: bool = True, group: int = GROUP
) -> DataFrame:
    """Every document's tokens in sequences of at most `size`, one row per piece.

    `tokenize` and then `pack`: (key, start, length, doc_tokens, ids_crc32,
    sequence_id, offset), and the piece's `ids` unless switched off. The pieces
    are written once in between. Empty and null texts are one `end_id`; repeated
    rows are packed as often as they occur; other columns are ignored.
    """
    cut = tokenize(docs, path, end_id, size, key, text)
    stored = written(cut if ids else cut.drop("ids"))
    return pack(stored, size, order=(key, "start"), group=group)
