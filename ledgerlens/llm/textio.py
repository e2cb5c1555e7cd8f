"""Words and rolling hashes inside tasks, shared by the operators on word windows."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd, and 3 or 5 modulo 8, so that differences of powers keep few factors of two.
BASES = (np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xC2B2AE3D27D4EB4B | 3))
CACHE_WORDS = 200_000
_M64 = (1 << 64) - 1


class WordHashes:
    """Two independent 64-bit hashes per word, remembered for frequent words within a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.low = np.empty(1 << 12, dtype=np.uint64)
        self.high = np.empty(1 << 12, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            n = len(known)
            if n == len(self.low):
                self.low, self.high = np.resize(self.low, 2 * n), np.resize(self.high, 2 * n)
            h = xxhash.xxh3_128_intdigest(w)
            known[w], self.low[n], self.high[n] = n, h & _M64, h >> 64
        at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        return self.low[at], self.high[at]


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each window of ``size`` hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    done = 0  # Horner's rule in doubling steps: window of 2k from two windows of k
    whole, width, step = hashes, 1, base
    with np.errstate(over="ignore"):
        todo = size
        while todo:
            if todo & 1:
                part = whole[done:done + n]
                out = out * _power(base, width) + part if done else part.copy()
                done += width
            todo >>= 1
            if todo:
                whole = whole[:len(whole) - width] * step + whole[width:]
                step = step * step
                width *= 2
    return mixed(out)


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits, so that any of them can choose a cell."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
