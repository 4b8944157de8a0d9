"""Vectorised text kernels for Arrow batches: word spans, word hashes and shingles.

Words are runs of bytes outside {0x20, 0x09-0x0D}. All hashes are 64-bit and
depend only on the bytes, so workers, runs and machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes hashed at once; a longer text forms a chunk of its own.
CHUNK = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.RandomState(20240117).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK
    while size < n:
        size *= 2
    return _powers(size)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z lower-cased if asked."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `size`-word shingles with repeats, and each row's first index (one more at the end).

    A row with 1 to size-1 words has its whole sequence as its one shingle.
    """
    counts = np.diff(first)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(int(starts[-1]), dtype=np.uint64)
    n = len(words) - size + 1
    if n > 0:
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            rolled += words[j : j + n] * factors[j]
        row = np.repeat(np.arange(len(counts)), counts)
        inside = row[:n] == row[size - 1 :]
        full = np.repeat(counts >= size, per_row)
        out[full] = mix(rolled[inside] + np.uint64(size))
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[first[r] : first[r + 1]]
        total = (own * factors[: len(own)]).sum(dtype=np.uint64)
        out[starts[r]] = mix(np.array([total], dtype=np.uint64) + np.uint64(len(own)))[0]
    return out, starts


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each row in order, its sorted distinct shingle hashes (uint64)."""
    data, offsets = text_buffers(column)
    for _, _, part, at in chunks(data, offsets):
        starts, ends, first = word_spans(part, at)
        hashes, rows = shingle_hashes(span_hashes(part, starts, ends), first, size)
        for i in range(len(at) - 1):
            yield np.unique(hashes[rows[i] : rows[i + 1]])
