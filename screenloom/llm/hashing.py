"""Vectorised 64-bit hashes of all stretches of a byte string."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Texts are hashed together up to about so many bytes, for which the powers are kept.
PART = 1 << 20


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


@lru_cache(2)
def kept_powers(base: int) -> np.ndarray:
    return powers_of(np.uint64(base), 2 * PART)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return kept_powers(int(base))[:n] if n <= 2 * PART else powers_of(base, n)


class Stretches:
    """Hashes of data[a:b] for any a and b, after one pass over the data."""

    def __init__(self, data: bytes) -> None:
        self.raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.raw + np.uint64(1)) * powers(BASE, len(data) + 1)[:-1], out=self.sums[1:])
        self.inverse = powers(UNBASE, len(data) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def parts(texts: list[str | None], most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters in all; a longer text is a range by itself."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def runs_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true marks."""
    edges = np.diff(np.concatenate(([False], marks, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k word hashes in a row, as signed longs."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out * BASE + words[j : j + n])
    return out.view(np.int64)
