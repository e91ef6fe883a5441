"""Vectorised word and shingle hashing over UTF-8 buffers (NumPy kernels)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        factor = np.full(size, _BASE if kind == "up" else _INVERSE)
        factor[0] = 1
        _powers[kind] = have = np.multiply.accumulate(factor)
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x + _U((0xD1B54A32D192ED03 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of one UTF-8 text, in order."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.empty(len(data) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_LOWER[data] if lower else data).astype(_U) * _pow("up", len(data))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow("down", len(data))[starts] + (ends - starts).astype(_U))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.zeros(len(w) - k + 1, _U)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * _U((0x9FB21C651E98DF25 * (2 * i + 1)) & (2**64 - 1))
    return np.unique(mix(total, k))
