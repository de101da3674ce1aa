"""Word shingles and circulant MinHash signatures, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

WORD_MEMO = 100_000
#: Shingles hashed at once; longer sets are folded block by block.
BLOCK = 1 << 15

_WEIGHTS = np.array([xxhash.xxh3_64_intdigest(b"weight %d" % i) | 1 for i in range(64)], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingler(width: int) -> Callable[[str | None], np.ndarray]:
    """Return a function from a text to its distinct shingles, sorted, as 64-bit values.

    A-Z is lower-cased and words are runs of bytes other than 20 and 09-0D.
    Fewer words than ``width`` make one shingle of them all; none make none.
    """
    memo = _Words()

    def shingles(text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        values = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(width, len(words))
        total = np.full(len(words) - n + 1, np.uint64(n) * _WEIGHTS[63])
        for j in range(n):
            total += values[j : len(values) - n + 1 + j] * _WEIGHTS[j]
        return np.unique(mix64(total))

    return shingles


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Circulant:
    """Signatures from two permutations of [0, 2^32).

    The first permutation scatters the shingles once.  Coordinate k is the
    minimum of the second permutation after its argument is shifted round the
    circle by k, so no further permutations are needed.  ``length`` asks for
    more coordinates than the bands take.
    """

    def __init__(self, bands: int, rows: int, length: int | None = None, seed: int = 0x9E3779B9):
        self.bands, self.rows, self.seed = bands, rows, np.uint32(seed)
        self.shifts = np.arange(1, max(bands * rows, length or 0) + 1, dtype=np.uint32)[:, None]
        self.band_ids = mix64(np.arange(1, bands + 1, dtype=np.uint64) * _WEIGHTS[62])

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        lowest = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(shingles), BLOCK):
            part = shingles[start : start + BLOCK]
            scattered = mix32(part.astype(np.uint32) ^ self.seed)
            for k in range(0, len(self.shifts), 16):
                shifted = mix32(scattered + self.shifts[k : k + 16])
                np.minimum(lowest[k : k + 16], shifted.min(axis=1), out=lowest[k : k + 16])
        return lowest

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; keys of different bands differ."""
        rows = signature[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        return mix64((rows * _WEIGHTS[: self.rows]).sum(axis=1, dtype=np.uint64) ^ self.band_ids).view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)
