"""Minhash signatures of sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

EMPTY = np.uint32(0xFFFFFFFF)


def seeds(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def signatures(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 200_000) -> np.ndarray:
    """``(rows, len(a))`` uint32 minima of multiply-add hashes; an empty set has all ones.

    ``values`` are the hashes of all rows one after the other, row ``i`` those between
    ``offsets[i]`` and ``offsets[i + 1]``. Works in bounded slices, whatever a row's length.
    """
    rows = len(offsets) - 1
    out = np.full((rows, len(a)), EMPTY, np.uint32)
    v = values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.uint64)
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    start = 0
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk, "right")) - 1)
        end = min(end, rows)
        part = v[offsets[start] : offsets[end]]
        filled = np.flatnonzero(np.diff(offsets[start : end + 1]))
        if len(part):
            at = offsets[start:end][filled] - offsets[start]
            for c in range(0, len(a), 16):
                h = ((part[:, None] * a[None, c : c + 16] + b[None, c : c + 16]) >> np.uint64(32)).astype(np.uint32)
                out[start + filled, c : c + 16] = np.minimum.reduceat(h, at, axis=0)
        start = end
    return out


def mix(columns: np.ndarray, salt: int) -> np.ndarray:
    """One int64 per row of a matrix of uint32, with ``salt`` mixed in."""
    h = np.full(len(columns), np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for c in range(columns.shape[1]):
        h = (h ^ columns[:, c].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h.view(np.int64)
