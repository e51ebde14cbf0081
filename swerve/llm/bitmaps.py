"""Compressed bitmaps of small numbers (below 65,536), many at a time.

A bitmap is either its bits or, where that is shorter, the gaps between its numbers with seven bits to a byte.
Arrays describe many bitmaps at once: the sorted numbers of all of them, one after the other, and where each begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPAN = 1 << 16


def binaries(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of values of these sizes that follow each other in parts."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


def encode(numbers: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bitmaps of numbers, ascending within each, none empty, and which of them hold bits."""
    if not len(begins):
        return pa.array([], pa.binary()), np.zeros(0, bool)
    ends = np.append(begins[1:], len(numbers))
    gaps = np.diff(numbers, prepend=0)
    gaps[begins] = numbers[begins] + 1
    length = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14)
    at = np.zeros(len(gaps) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    data = np.zeros(at[-1], np.uint8)
    for k in range(3):
        some = length > k
        data[at[:-1][some] + k] = (gaps[some] >> (7 * k)) & 127 | np.where(length[some] > k + 1, 128, 0)
    sizes = at[ends] - at[begins]
    bits = (numbers[ends - 1] >> 3) + 1
    dense = bits < sizes
    if not dense.any():
        return binaries(data, sizes), dense
    parts = []
    for b, e, lo, hi, n, full in zip(begins.tolist(), ends.tolist(), at[begins].tolist(), at[ends].tolist(), bits.tolist(), dense.tolist(), strict=True):
        if full:
            one = np.zeros(n * 8, np.uint8)
            one[numbers[b:e]] = 1
            parts.append(np.packbits(one, bitorder="little"))
        else:
            parts.append(data[lo:hi])
    return binaries(np.concatenate(parts), np.where(dense, bits, sizes)), dense


def decode(column: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the bitmap and number, for each number of all bitmaps; by bitmap, ascending."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    which, numbers = [], []
    for i in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(data[offsets[i] : offsets[i + 1]], bitorder="little"))
        which.append(np.full(len(found), i, np.int64))
        numbers.append(found)
    thin = np.flatnonzero(~dense)
    if len(thin):
        sizes = (offsets[1:] - offsets[:-1])[thin]
        owner = np.repeat(thin, sizes)
        raw = data[offsets[0] : offsets[-1]] if len(thin) == len(column) else np.concatenate([data[offsets[i] : offsets[i + 1]] for i in thin])
        last = raw < 128
        begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw))))
        gaps = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins)
        owner = owner[begins]
        total = np.cumsum(gaps)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        before = np.repeat(total[first] - gaps[first], np.diff(np.append(first, len(owner))))
        which.append(owner)
        numbers.append(total - before - 1)
    which, numbers = np.concatenate(which), np.concatenate(numbers)
    if dense.any() and len(thin):
        order = np.argsort(which, kind="stable")
        which, numbers = which[order], numbers[order]
    return which, numbers
