"""Hashes of words and word shingles for many texts at once, in numpy.

A word's hash is a polynomial over random byte values modulo 2**64, taken from prefix sums over
all bytes of a batch and moved to the word's start by the inverse of the factor; a final mixing
step spreads it. All constants are fixed, so every task gives the same hashes.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.RandomState(7)
_BYTE = _RANDOM.randint(0, 2**63 - 1, size=256, dtype="int64").astype("uint64")
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 2**64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, "uint64"), np.ones(1, "uint64")


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _FACTOR, "uint64"), np.full(size, _INVERSE, "uint64")
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z in lower case), and where each text's words begin (one more at the end)."""
    parts = [(t or "").encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", "uint8")
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    space = _SPACE[data]
    edge = np.diff(space.astype("int8"), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, bounds)


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of ``size`` words of all texts, where each text's shingles begin, and the texts' numbers of words.

    A text with fewer words, but at least one, has its whole sequence as its one shingle.
    """
    hashes, begin = words(texts)
    count = np.diff(begin)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(begin[:-1] - first[:-1], n) + np.arange(first[-1])
    return window_hashes(hashes, at, np.repeat(begin[1:], n), size), first, count


def window_hashes(hashes: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words that start at ``at``; words from ``end`` on are absent."""
    out = np.zeros(len(at), "uint64")
    padded = np.append(hashes, np.zeros(size, "uint64"))
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(at + i < end, padded[at + i], np.uint64(i + 1)))
    return out
