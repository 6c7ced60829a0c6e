"""64-bit hashes of many words at once: ranges of a byte array by prefix sums."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair: a polynomial over random byte values, then mixed."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(_BASE))])
        back = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))])
        prefix = np.r_[np.uint64(0), np.cumsum(_TABLE[data] * power[:-1])]
        hashes = (prefix[end] - prefix[start]) * back[start]
        hashes ^= hashes >> np.uint64(31)
        hashes *= MIX
        hashes ^= hashes >> np.uint64(29)
    return hashes
