"""64-bit hashing of words, sets and byte ranges in numpy; all sums wrap around."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=None)
def odd(n: int) -> np.uint64:
    """The n-th of a series of odd multipliers."""
    return mix(np.array([n + 1], dtype=U) * U(0x9E3779B97F4A7C15))[0] | U(1)


class WordHashes(dict):
    """word -> hash, emptied when it has grown to a hundred thousand words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U, count=len(words))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[U(1)], np.full(size, U(b))]), dtype=U) for b in (base, inverse))
    return up, down, mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Ranges:
    """Hashes of any byte ranges of one text."""

    def __init__(self, raw: np.ndarray):
        up, self.down, table = _powers(1 << max(20, int(len(raw)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, dtype=U)
            np.cumsum(table[raw] * up[: len(raw)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def every(self, width: int) -> np.ndarray:
        """Of each range of this width, by its start."""
        n = len(self.sums) - width
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + U(width))
