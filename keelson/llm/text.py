"""Vectorised word handling over Arrow text columns.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r, so words are found in UTF-8
bytes without decoding.  Word hashes are 64-bit polynomial sums taken from one prefix sum
over the bytes of a slice; documents are never cut, slices hold whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: everything but ASCII letters and digits and the bytes of longer characters
NOT_ALNUM = np.array([not (chr(c).isalnum() and c < 128) and c < 128 for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _UNBASE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each; kept for the largest
    slice so far, as every slice of a task needs them."""
    size = SLICE_BYTES + (1 << 16)
    while size < n:
        size *= 2
    return _powers(size)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values (null counts as empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[raw[0]:raw[-1]], raw - raw[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches between rows so that each piece holds about ``limit`` text bytes
    (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    data: np.ndarray      # bytes of the slice
    offsets: np.ndarray   # documents in data
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    doc: np.ndarray       # row of each word
    first: np.ndarray     # first word of each row, and the total at the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, gaps: np.ndarray = _BLANK) -> Words:
    """Words of all texts; ``gaps`` marks the bytes that stand between words."""
    data, offsets = text_bytes(column)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(gaps[data], out=inside[1:-1])
    body = inside[1:-1]
    opens, closes = body & ~inside[:-2], body & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = body[edges]
    closes[edges - 1] = body[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    table = _LETTER[_LOWER] if lower else _LETTER
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_hashes(w: Words, lower: bool) -> np.ndarray:
    return span_hashes(w.data, w.start, w.end, lower)


def blanks(data: np.ndarray) -> np.ndarray:
    return _BLANK[data]


def running(flags: np.ndarray) -> np.ndarray:
    """n + 1 running counts, so that a range's count is a difference."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one document, and the word each starts at."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k:k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    return mix(out[at]), at


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def list_array(values: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
