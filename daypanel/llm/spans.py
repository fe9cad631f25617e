"""Words of many texts at once: where they lie in a batch's bytes, the distinct ones among them, and their hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Which bytes are white space, letters, digits and signs in UTF-8 of plain Latin text.
SPACE, LETTER, DIGIT, SIGN, ODD = 0, 1, 2, 3, 4
CLASSES = np.full(256, ODD, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[33:127] = SIGN
CLASSES[48:58] = DIGIT
CLASSES[65:91] = CLASSES[97:123] = LETTER
CLASSES[128:192] = CLASSES[0xC3] = LETTER


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 places where its texts begin and end; null is empty."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The array in runs of texts of about `most` bytes, one text at least, and where each begins."""
    sizes = np.frombuffer(texts.cast(pa.large_binary()).buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, told apart by their bytes, in order of appearance, and for each span its place among them.

    Spans are in order and don't overlap.
    """
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    held = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    bounds = np.append(0, np.cumsum(ends - starts))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    coded = spans.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of a cryptographic hash of each word: two given words agree with a chance of 2**-64."""
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), "<u8").astype(np.uint64)


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space, each inside one text."""
    full = CLASSES[data] != SPACE
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = full[edges]
    stop = full.copy()
    stop[:-1] &= ~full[1:] | begin[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words that the vocabulary's tokens don't reach across.

    Plain Latin is put in lower case and cut into runs of letters, single
    digits, runs of signs, and contractions, as the vocabulary does. A run
    between white space with anything else in it, or with `<|`, is one word as
    it stands.
    """
    kind = CLASSES[data]
    before = np.empty_like(data)
    if len(data):
        before[0], before[1:] = 0, data[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = 0
    high = data >= 128
    # Two-byte letters À to ÿ, without the signs × and ÷.
    second = high & (before == 0xC3)
    bad = (kind == ODD) | high & (data != 0xC3) & ~second | second & ((data == 0x97) | (data == 0xB7))
    bad |= (data == 124) & (before == 60)
    low = lower(data)
    low[second & (data >= 0x80) & (data <= 0x9E)] += 32
    begin = kind != SPACE
    same = np.zeros(len(data), bool)
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != DIGIT)
    same[edges] = False
    begin &= ~same
    # Contractions stand where a run of signs that is one apostrophe begins.
    marks = np.flatnonzero((low == 39) & begin)
    if len(marks):
        text_end = offsets[np.searchsorted(offsets, marks, "right")]
        at = lambda k: np.where(marks + k < text_end, low[np.minimum(marks + k, len(low) - 1)], 0)
        one, two = at(1), at(2)
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, [115, 116, 109, 100])
        for found, size in ((marks[short], 2), (marks[long & ~short], 3)):
            begin[found + 1] = False
            rest = found + size
            rest = rest[rest < len(low)]
            begin[rest] |= kind[rest] != SPACE
    cut = begin | (kind == SPACE)
    places = np.flatnonzero(cut)
    is_word = begin[places]
    starts, ends = places[is_word], np.append(places[1:], len(data))[is_word]
    if not bad.any():
        return low, starts, ends
    first, last = blank_words(data, offsets)
    odd = np.zeros(len(first), bool)
    odd[np.searchsorted(first, np.flatnonzero(bad), "right") - 1] = True
    plain = ~odd[np.searchsorted(first, starts, "right") - 1]
    starts, ends = np.concatenate([starts[plain], first[odd]]), np.concatenate([ends[plain], last[odd]])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first[odd]] += 1
    inside[last[odd]] -= 1
    whole = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    order = np.argsort(starts, kind="stable")
    return np.where(whole, data, low), starts[order], ends[order]
