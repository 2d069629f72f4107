"""Vectorised word and shingle hashes of many documents at once."""

from __future__ import annotations

import functools

import numpy as np

from .common import mix64
from .exchange import batches

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240)
#: A random odd number for each byte, and the base of the polynomial hash with its inverse.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        x = np.full(n, b, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return up(BASE), up(_INVERSE)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, between bytes 9-13 and 32) and the document it is in."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    room = 1 << max(20, int(n).bit_length())
    power, inverse = _powers(room)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[low] * power[:n], out=sums[1:])
    hashes = mix64((sums[b] - sums[a]) * inverse[a] ^ (b - a).astype(np.uint64))
    return hashes, np.searchsorted(offsets, a, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles; with fewer words, of all of them as one."""
    out = [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    a_ = np.uint64(0xD6E8FEB86659FD93)
    for lo, hi in batches(offsets):
        words, doc = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        count = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])
        if len(words) >= size:
            h = words[: len(words) - size + 1].copy()
            for k in range(1, size):
                h = h * a_ + words[k : len(words) - size + 1 + k]
            h = mix64(h)
        for d in range(hi - lo):
            n, f = count[d], first[d]
            if n >= size:
                out[lo + d] = np.unique(h[f : f + n - size + 1])
            elif n:
                x = int(n)
                for w in words[f : f + n].tolist():
                    x = (x * int(a_) + w) % (1 << 64)
                out[lo + d] = mix64(np.array([x ^ 0x5BD1E995], np.uint64))
    return out
