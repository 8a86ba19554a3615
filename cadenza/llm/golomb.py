"""Golomb-Rice coding of ascending integers, as numpy array operations.

A gap g is written as the quotient g >> k in unary (zeros closed by a one) and its low k bits. The two
parts lie in two bit streams, so that coding and decoding need no loop over values.
"""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """k and the code of distinct values >= 0 in ascending order."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69))))
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(low).tobytes() + np.packbits(unary).tobytes()


def decode(k: int, n: int, code: bytes) -> np.ndarray:
    """The n values of a code."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(code, dtype=np.uint8)
    cut = (n * k + 7) // 8
    low = np.unpackbits(raw[:cut])[: n * k].reshape(n, k).astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    ones = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    gaps = ((np.diff(ones, prepend=-1) - 1) << k) + low
    return np.cumsum(gaps + 1) - 1
