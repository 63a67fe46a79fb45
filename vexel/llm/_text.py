"""Shared batch helpers: bounded slices of Arrow batches, ragged gathers, and word hashes in numpy."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at a time in a Python worker.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `limit` bytes of `column` (one longer row stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data = string_column(batch, column)
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1]
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to


def free(name: str, taken) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def string_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large_string; nulls stay null."""
    a = batch.column(batch.schema.get_field_index(column))
    return a if pa.types.is_large_string(a.type) else a.cast(pa.large_string())


def trim() -> None:
    """Give freed memory back at the end of a task: workers live on, and share their machine with the next stage's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column on end, and the row bounds within them. Null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string()
    a = column.cast(kind).fill_null("") if column.null_count else column.cast(kind)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if a.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all elements of the runs (start, len), and the bounds of each run in the result."""
    bounds = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=bounds[1:])
    at = np.arange(bounds[-1], dtype=np.int64)
    at += np.repeat(starts - bounds[:-1], lens)
    return at, bounds


def string_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large_string array over UTF-8 bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def _mixed(seed: int, n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(11, 256)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    p = np.empty(n, np.uint64)
    if n:
        p[0] = 1
        p[1:] = _STEP
        np.multiply.accumulate(p, out=p)
    return p


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span. Spans are non-empty, apart and in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at, bounds = ragged(starts, lens)
    inner = np.arange(len(at), dtype=np.int64) - np.repeat(bounds[:-1], lens)
    values = _BYTE[data[at]] * _powers(int(lens.max()))[inner]
    return mix(np.add.reduceat(values, bounds[:-1]) + lens.astype(np.uint64))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words `[^\\x20\\x09-\\x0D]+`, and the number of words before each row bound."""
    starts, ends = runs(_IS_WORD[data], bounds)
    return starts, ends - starts, np.searchsorted(starts, bounds)
