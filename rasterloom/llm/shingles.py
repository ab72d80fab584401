"""Shingle sets of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a task's table, and the longest word kept there. A full table stays as it is: frequent words come early.
KEPT_WORDS, KEPT_BYTES = 100_000, 64
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES and len(self) < KEPT_WORDS:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[3])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[4])
    return x ^ (x >> np.uint64(32))


class Shingler:
    """set_of(text): the distinct shingles of k words of a whole text, A-Z lower-cased; with fewer
    words the whole sequence as one; nothing without words."""

    def __init__(self, k: int):
        self.k, self.words = k, _Words()

    def set_of(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        m, k = len(words), self.k
        if not m:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, m)
        if m < k:
            total = 0x51ED270B + m
            for x in h.tolist():
                total = ((total ^ x) * _MIX[0] + _MIX[1]) % (1 << 64)
            return np.array([total], np.uint64)
        total = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            total = mixed(total + h[i : m - k + 1 + i]) if i else h[: m - k + 1] * np.uint64(_MIX[0])
        return np.unique(total)
