"""Words and rolling hashes of Arrow text columns, as numpy arrays.

A batch is handled in slices of whole documents with about ``SLICE`` bytes of
text, so that memory follows the longest document and not the batch.  All
hashes are of UTF-8 bytes and the same in every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
STEP = 1 << 19  # tables of powers grow by so many
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93

class Cache(dict):
    """A dict that travels empty: functions go to tasks by value, with what they refer to."""

    def __reduce__(self):
        return Cache, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = Cache()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = -(-max(n - 1, 1) // STEP) * STEP + 1
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have


def trimmed(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, after which the worker gives free memory back to the system.

    Workers outlive their tasks, several of them a core; what the allocators
    keep would add up with the work of the next stages.
    """
    def own(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return own


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of each ``values[start:end]``; equal spans have equal hashes wherever they stand."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(BASE2))


def plain(column) -> pa.Array:
    """One array of strings with '' for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings without nulls; the offsets start at 0."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no document: (start, end, first run of each document and the total)."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    start = np.flatnonzero(after & (~before | cut))
    end = np.flatnonzero(before & (~after | cut))
    return start, end, np.searchsorted(start, offsets)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and 9 to 13: (start, end, first word of each document and the total)."""
    return runs(~is_space(data), offsets)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` consecutive words of one document start."""
    n = np.diff(first)
    ok = np.ones(int(first[-1]), bool)
    for d in np.flatnonzero(n < size):
        ok[first[d] : first[d + 1]] = False
    full = np.flatnonzero(n >= size)
    ends = first[full + 1]
    for back in range(1, size):
        ok[ends - back] = False
    return np.flatnonzero(ok)
