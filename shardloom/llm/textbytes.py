"""Vectorised work on the UTF-8 bytes of a batch of texts, shared by the text operators.

Everything here handles one Arrow batch inside one task; Spark does the partitioning around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: U+0009 to U+000D and the space: what parts words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE_BYTES = 2 << 20
#: Where rows are handled one by one: a slice needs about fifty times its bytes for a moment.
SMALL_SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, elementwise and wrapping."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, dtype=U64), np.full(n, _R_INV, dtype=U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n at least."""
    return _powers(1 << max(16, int(n).bit_length()))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of code[data[k]] * r**k over i <= k < j (wrapping)."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever the span lies."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; a null counts as empty.

    One longer text makes a run of its own, so memory is bounded by the limit and the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (no blanks inside) and, by row, the index of its first word (with the total at the end)."""
    solid = ~BLANK[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    edge = inner[(inner > 0) & (inner < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


_LAG = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the ascending distinct 64-bit hashes of its word shingles, A-Z lower-cased.

    A text with fewer words than ``width`` gives its whole word sequence as one shingle; none without words.
    """
    for _, data, offsets in slices(column, SMALL_SLICE):
        data = _LOWER[data]
        start, end, by_row = words(data, offsets)
        codes = span_hashes(prefix_hashes(data), start, end)
        whole = np.zeros(max(0, len(codes) - width + 1), dtype=U64)
        for k in range(width):
            whole += codes[k : k + len(whole)] * _LAG[k]
        whole = mix(whole)
        for a, b in zip(by_row[:-1], by_row[1:], strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                short = (codes[a:b] * _LAG[: b - a]).sum(dtype=U64) + U64(b - a)
                yield mix(np.array([short], dtype=U64))
            else:
                yield np.zeros(0, dtype=U64)
