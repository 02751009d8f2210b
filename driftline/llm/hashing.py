"""Hashes of words and of runs of words, as numpy arrays of unsigned 64-bit integers."""

from __future__ import annotations

import numpy as np
import xxhash

_PRIME = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for the task and emptied at a quarter million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(2 * n, _PRIME, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def runs(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of word hashes; ``starts`` ascend from 0 and each run holds a word."""
    if not len(h):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(h)))
    inside = np.arange(len(h)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(mix(h) * powers(int(lengths.max()))[inside], starts) + lengths.astype(np.uint64))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``n`` words, or of the whole if there are fewer."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(n, len(h))
    p, spread = powers(n), mix(h)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += spread[i : len(h) - n + 1 + i] * p[i]
    return np.unique(mix(total + np.uint64(n)))
