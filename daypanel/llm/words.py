"""Words of a text, and the token ids of each, for the vocabulary whose words end at white space."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa

from daypanel.llm import spans

# What the vocabulary's own pre-tokenizer calls white space, and its word pattern on plain text.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Anything but white space, signs, digits and Latin letters that lower case and composition leave simple.
UNPLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+")
BESIDES_LETTERS = re.compile("'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\\[-`{-~]+")
#: Bytes of words and ids that a worker remembers: in two halves, of which the one that was used less lately is forgotten.
REMEMBERED = 48 << 20
#: Longer words, in bytes, hardly repeat; they are encoded where they stand and not remembered.
LONG_WORD = 256


def split_words(text: str, special: tuple[str, ...]) -> list[str]:
    """Words such that the ids of a text are those of its words in order.

    A plain text is put in lower case and cut into runs of letters, single
    digits, runs of signs, and contractions. Any other text is only cut at white
    space, over which neither tokens nor composed characters reach, and its
    plain words as before; the rest stay as they are. `special` are strings that
    the tokenizer takes whole, wherever they stand.
    """
    if UNPLAIN.search(text) is None and not any(s in text for s in special):
        return BESIDES_LETTERS.sub(r" \g<0> ", text.lower()).split()
    words: list[str] = []
    for word in SPACE.split(text):
        if UNPLAIN.search(word) is None and not any(s in word for s in special):
            words += BESIDES_LETTERS.sub(r" \g<0> ", word.lower()).split()
        elif word:
            words.append(word)
    return words


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Encoder:
    """Ids of words as little-endian unsigned 32-bit integers; `given` has the ids of words encoded before.

    The merges are the tokenizers library's: a plain word goes to them at once,
    any other through the whole tokenizer.
    """

    def __init__(self, path: str, given: dict[bytes, bytes] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.given = given or {}
        self.learnt: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def encode_word(self, word: str) -> bytes:
        """The ids of a word of `spans.word_spans`: at once if it is plain, else cut further."""
        return self._merged(word) if PLAIN_WORD.fullmatch(word) else b"".join(map(self._part, split_words(word, self.special)))

    def _part(self, word: str) -> bytes:
        if PLAIN_WORD.fullmatch(word):
            return self._merged(word)
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the n + 1 places where each text's begin and end.

        The words are found in the batch's bytes and told apart by them; each
        distinct one is looked up, or cut out and encoded, once.
        """
        data, offsets = spans.buffers(texts)
        low, starts, ends = spans.word_spans(data, offsets)
        words, inverse = spans.distinct(low, starts, ends)
        found = [self.look_up(w) for w in words]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        begins, own = np.cumsum(sizes) - sizes, sizes[inverse]
        stops = np.cumsum(own)
        total = int(stops[-1]) if len(stops) else 0
        ids = pool[np.repeat(begins[inverse] - stops + own, own) + np.arange(total)]
        return ids, np.append(0, stops)[np.searchsorted(starts, offsets)]

    def look_up(self, word: bytes) -> bytes:
        """The ids of a word, encoded unless it was given or learnt."""
        ids = self.given.get(word)
        if ids is None:
            ids = self.learnt.get(word)
        if ids is None:
            ids = self.before.get(word)
            if ids is None:
                ids = self.encode_word(word.decode())
            if len(word) <= LONG_WORD:
                if self.held > REMEMBERED // 2:
                    self.before, self.learnt, self.held = self.learnt, {}, 0
                self.learnt[word] = ids
                # The objects that hold them take some 170 bytes.
                self.held += len(word) + len(ids) + 170
        return ids

    def _merged(self, plain: str) -> bytes:
        shown = plain if plain.isascii() else "".join(self.letters[b] for b in plain.encode())
        ids = [t.id for t in self.merges.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)
