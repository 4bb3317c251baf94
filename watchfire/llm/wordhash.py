"""Hashes of words and word windows, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all beyond a number of words, so that memory stays bounded."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word)
        return h

    hash = staticmethod(xxhash.xxh3_64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, from the words' hashes; empty if there are fewer than n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= _ODD[0]
        out += h[i : i + m]
        if i + 1 < n:
            out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; the whole sequence is one if it is shorter; empty without words."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(h, min(n, len(h))))
