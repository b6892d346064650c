"""Whole numbers as variable-length bytes, whole arrays at a time: seven bits a byte, lowest first, the top bit set where more follow."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative ``values`` and where each value begins, with the total length as the last entry."""
    v = np.asarray(values).astype(np.uint64)
    width = np.ones(len(v), np.int64)
    limit = 1 << 7
    while len(v) and limit <= int(v.max()):
        width += v >= np.uint64(limit)
        limit <<= 7
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(width.max()) if len(v) else 0):
        own = width > k
        low = (v[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[at[:-1][own] + k] = low | ((width[own] > k + 1).astype(np.uint8) << 7)
    return out, at


def unpack(data: np.ndarray | bytes) -> np.ndarray:
    """The values of :func:`pack`."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes | memoryview) else data
    if not len(data):
        return np.empty(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)
