"""Vectorised 64-bit hashes of words and word shingles over Arrow text buffers."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93 | 1
_P_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18) + 1
        tables = []
        for p in (_P, _P_INV):
            steps = np.full(size, p, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII letters lower-cased) of all texts, and each text's offsets in them.

    A word's hash is a polynomial over its bytes, taken from one running sum
    over the whole buffer, then mixed.
    """
    n = len(raw)
    texts = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    white = _WHITE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    solid = ~white
    starts = solid.copy()
    starts[1:] &= white[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= white[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
    h = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD
    return mix(h), np.searchsorted(s, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of a text with fewer
    words its whole sequence is the one shingle, and a text without words has none."""
    h, at = word_hashes(raw, offsets)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        words = b - a
        if words >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif words:
            out.append(mix(np.array([(h[a:b] * weights[:words]).sum(dtype=np.uint64) + np.uint64(words)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
