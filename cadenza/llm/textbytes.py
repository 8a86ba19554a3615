"""Numpy helpers over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)

#: The bytes 0x20 and 0x09 to 0x0D separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The code of each byte, upper-case A-Z taken as lower-case.
FOLDED_CODES = _BYTE_CODES[_LOWER]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and where each row starts (one more entry: the end). Nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@functools.cache
def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half the output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = FOLDED_CODES) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]; runs are in order and do not overlap. Equal bytes, equal hash."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= SEGMENT:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(codes[data[a:b]] * _powers(_M)[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _powers(_M_INVERSE)[s]
        else:  # one run longer than a segment
            total, scale = 0, 1
            for k in range(a, b, SEGMENT):
                part = data[k : min(b, k + SEGMENT)]
                total += int(np.sum(codes[part] * _powers(_M)[: len(part)], dtype=np.uint64)) * scale
                scale = scale * pow(_M, len(part), 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mixed(out + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all rows, and the number of the first word of each row (one more entry: the count)."""
    inside = ~IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, ascending, of the runs of k words; of the whole sequence if it is shorter; none of no words."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    length = min(n, k)
    h = np.full(n - length + 1, length, dtype=np.uint64)
    for j in range(length):
        h = mixed(h * np.uint64(_M) + word_hashes[j : j + len(h)])
    return np.unique(h.view(np.int64))
