"""Token ids of whole texts by a public tokenizer file, fast enough for a whole corpus.

The vocabulary ``word_bpe_49k.json`` drops white space and splits at it, so a text's ids are the ids
of its white-space-separated chunks in order.  Each worker keeps the ids of the chunks and words it
has seen (bounded) and asks the tokenizers library for the others only.  A chunk of Latin letters,
with or without a tail of punctuation, goes straight to the library's BPE model as lower-case
letters in the byte-level spelling; any other chunk goes through the library's full encoding."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

END = 2
#: chunks and words a worker keeps in one table, and words it keeps once that is full
MAX_CHUNKS, MAX_WORDS = 900_000, 100_000
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_TAIL = ".,;:!?"
#: white space to Python but not to the tokenizer
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_PLAIN_SPACE = re.compile(r"[ \n\r\t]+")


def _byte_spelling() -> dict[int, str]:
    """Latin-1 letters as byte-level BPE writes them: a printable byte stands for itself, the others
    for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    of_byte = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SPELLING = _byte_spelling()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, without an end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A run of lower-case Latin letters, which is also the chunk of this spelling."""
        ids = self.chunks.get(word) or self.words.get(word)
        if ids is None:
            spelt = word if word.isascii() else word.translate(_SPELLING)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
            if len(self.chunks) < MAX_CHUNKS:
                self.chunks[word] = ids
            elif len(self.words) < MAX_WORDS:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        head = chunk.rstrip(_TAIL)
        if not _WORD.fullmatch(head):
            ids = self.library(chunk)
        elif len(head) == len(chunk):
            ids = self._word(head.lower())
        else:
            ids = self._word(head.lower()) + self[chunk[len(head):]]
        if len(self.chunks) < MAX_CHUNKS:
            self.chunks[chunk] = ids
        return ids

    def __getitem__(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        return self._chunk(chunk) if ids is None else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = _PLAIN_SPACE.split(text) if any(c in text for c in _ODD) else text.split()
        found = list(map(self.chunks.get, parts))
        if None in found:
            found = [self._chunk(p) if f is None else f for p, f in zip(parts, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
