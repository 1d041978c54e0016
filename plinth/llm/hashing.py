"""Vectorised hashes of byte ranges, by prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: For each of two independent hashes: a random odd number for each byte.
TABLES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * _U(k)) | _U(1) for k in (0xD1342543DE82EF95, 0xA0761D6478BD642F))


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    """base**0, base**1, ... (or its inverses) modulo 2**64."""
    have = _powers.get((which, inverse), np.empty(0, np.uint64))
    if len(have) < n:
        base = pow(_ODD[which], -1 if inverse else 1, 1 << 64)
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _powers[which, inverse] = np.cumprod(step)
    return have[:n]


class Ranges:
    """Hashes of ranges of a byte buffer: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, n = which, len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLES[which][data] * _power(which, n, False), out=self.sums[1:])
        self.back = _power(which, n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9FB21C651E98DF25) + mix(b))
