"""Word and shingle hashes of texts, in numpy inside Spark tasks.

A word is a run of characters other than space and the five controls 0x09-0x0D, with the
letters A-Z lower-cased: on UTF-8 bytes that is ``lower().split()``."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_CACHED_WORDS = 400_000
_MIX1 = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash by word; past ``MAX_CACHED_WORDS`` entries words are hashed without being kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MAX_CACHED_WORDS:
            self[word] = value
        return value


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8").lower().split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` words; the order of the words counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:n] + _MIX1)
    for k in range(1, width):
        out = mix(out * _MIX1 + hashes[k:k + n])
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles; with fewer words the whole
    sequence is one shingle; without words the set is empty."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))
