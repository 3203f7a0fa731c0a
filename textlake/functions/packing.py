"""Rows of (number, count) entries as bytes: about two bytes an entry where numbers are dense, instead of eight.

A row's numbers ascend; their gaps come first, then the counts, each as a
varint (seven bits a byte, the lowest first). Whole columns are packed and
unpacked at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and first entry of each row, and where the gap and the count of each entry stand among all values."""
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    gap = np.arange(len(row)) + starts[row]
    return row, starts, gap, gap + sizes[row]


def pack(sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column of ``len(sizes)`` rows; a row has ``sizes`` entries, its numbers ascend from 0 or more."""
    _, starts, gap_at, count_at = _layout(sizes)
    gaps = np.diff(numbers, prepend=0)
    first = starts[sizes > 0]
    gaps[first] = numbers[first]
    values = np.empty(2 * len(numbers), np.int64)
    values[gap_at], values[count_at] = gaps, counts
    width = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        width += rest > 0
        rest >>= 7
    ends = np.cumsum(width)
    at = ends - width
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for j in range(width.max(initial=0)):
        some = np.flatnonzero(width > j)
        out[at[some] + j] = values[some] >> (7 * j) & 127 | (width[some] > j + 1) << 7
    offsets = np.append(0, ends)[2 * np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, count) of every entry of a column that :func:`pack` made; it has no nulls."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None or not data.size:
        return (np.zeros(0, np.int64),) * 3
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    last = data < 128
    ends = np.flatnonzero(last)
    at = np.append(0, ends[:-1] + 1)[:len(ends)]
    width = ends - at + 1
    values = np.zeros(len(ends), np.int64)
    for j in range(width.max(initial=0)):
        some = np.flatnonzero(width > j)
        values[some] |= (data[at[some] + j] & 127).astype(np.int64) << (7 * j)
    sizes = np.diff(np.append(0, np.cumsum(last))[offsets - offsets[0]]) // 2
    row, starts, gap_at, count_at = _layout(sizes)
    sums = np.cumsum(values[gap_at])
    return row, sums - np.append(0, sums)[starts][row], values[count_at]
