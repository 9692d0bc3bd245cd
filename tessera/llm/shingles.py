"""Hashed word shingles of UTF-8 text, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_FACTORS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Most words that a WordHashes keeps.
CACHE_WORDS = 400_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once while the word stays in the cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, which is what is meant."""
    return text.lower().split() if text else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + U(seed * int(_FACTORS[1]) & (1 << 64) - 1)
    x = (x ^ (x >> U(32))) * _FACTORS[3]
    x = (x ^ (x >> U(29))) * _FACTORS[4]
    return x ^ (x >> U(32))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a sequence of word hashes, in order; shorter sequences: the whole as one; none: none."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], U)
    m = len(h) - n + 1
    out = np.zeros(m, U)
    for i in range(n):
        out = (out ^ h[i : i + m]) * _FACTORS[i % 5] + (out >> U(31))
    return mix(out)


def shingle_set(text: bytes | None, n: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(windows(cache.of(words(text)), n))
