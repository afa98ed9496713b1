"""Hashes of words and of word shingles, for work inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SHIFT = np.uint64(29)
_HALF = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words: only speed depends on what is remembered."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the SHINGLE-word shingles, A-Z in lower case. Fewer words: the whole sequence as one.

    bytes.split and bytes.lower know ASCII only: space, TAB to CR, and A-Z.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = hashes.of(words)
    out = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        x = h[k : n - SHINGLE + 1 + k] * _MIX[k]
        x ^= x >> _SHIFT
        x *= _MIX[(k + 1) % SHINGLE]
        out += x
        out ^= out >> _HALF
    return np.unique(out)
