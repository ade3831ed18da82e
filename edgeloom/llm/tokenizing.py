"""Exact tokenizer ids by way of caches that are kept by piece of text; runs inside Spark's Python tasks."""

from __future__ import annotations

import functools
import re

import numpy as np
import regex

#: Entries of a cache, after which it starts anew.
CACHE = 700_000
#: Texts of these characters only need no Unicode normalisation, and every library agrees on their classes.
PLAIN = re.compile("[^\t-\r -~\x85\xa0-˿]")


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    counted from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def as_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(byte_letters())


class WordIds:
    """Ids of a vocabulary that lower-cases, drops white space and takes words apart by WORDS. White space always
    parts words, so the ids of a chunk without white space don't depend on what stands around it."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """As the library gives them."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self.words[word] = np.array([t.id for t in self.model.tokenize(as_letters(word))], "<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text, each as four little-endian bytes."""
        if PLAIN.search(text) or self.special and "<|" in text and self.special.search(text):
            return self.whole(text)
        chunks = text.lower().split()
        known = self.chunks
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) >= CACHE:
            known.clear()
        for c in chunks:
            if c not in known:
                known[c] = b"".join(map(self._word, self.WORDS.findall(c)))
        return b"".join([known[c] for c in chunks])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker; it stays from task to task."""
    return WordIds(path)
