"""Vectorised hashing of word shingles in UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64), out=out[1:]) if n > 1 else None
    return out


_cache = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the longest text so far."""
    if _cache["n"] < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        down = np.empty(n, np.uint64)
        down[0] = 1
        np.multiply.accumulate(np.full(n - 1, inverse, np.uint64), out=down[1:])
        _cache.update(n=n, up=_powers(n), down=down)
    return _cache["up"], _cache["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of an A-Z-lower-cased text, in order."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text is one shingle, one without words none."""
    h = word_hashes(text or b"")
    n = min(words, len(h))
    if not n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out * _ODD) ^ h[j : j + m]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))
