"""Vectorised helpers that run inside Arrow tasks: words, word hashes, n-gram hashes, key blobs.

Text stays as UTF-8 bytes.  White space is always ``[\\x20\\x09-\\x0D]``; those bytes never occur
inside a multi-byte character, so byte positions and character positions of words agree in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
_M1 = _U(0xBF58476D1CE4E5B9)
_M2 = _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total, first = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > first and total + n > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)


@dataclass
class Words:
    """Words of a batch: byte ranges, 64-bit hashes, and the range of words of each row."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # words of row i: offsets[i] .. offsets[i+1]

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def room(self, k: int) -> np.ndarray:
        """True where k words from here on lie in one row."""
        return np.arange(len(self.starts)) + k <= np.repeat(self.offsets[1:], np.diff(self.offsets))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = offsets[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, ends, range_hashes(_LOWER[data] if lower else data, starts, ends), bounds)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (ascending, not overlapping, not empty)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _BYTE[data[np.repeat(starts, lengths) + at]] * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position on (only those with room for k make sense)."""
    n = len(hashes)
    if n < k:
        return np.zeros(n, np.uint64)
    up = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * powers(n - k + 1, _INVERSE))
    return out


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on; shorter windows at the end."""
    out, have = values.copy(), 1
    while have < w:
        step = min(have, w - have)
        if len(out) > step:
            out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ascending by row and then by value."""
    order = np.argsort(rows)
    rows, values = rows[order], values[order]
    same = np.zeros(len(rows) + 1, dtype=bool)
    same[1:-1] = rows[1:] == rows[:-1]
    many = np.flatnonzero(same[1:] | same[:-1])  # rows of several values; only those need a second key
    if len(many) == 0:
        return rows, values
    values[many] = values[many][np.lexsort((values[many], rows[many]))]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def sorted_sets(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ascending, where values[offsets[i]:offsets[i+1]] belong to row i."""
    values = values.copy()
    keep = np.ones(len(values), dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        values[a:b].sort()
    keep[1:] = values[1:] != values[:-1]
    first = offsets[:-1]
    keep[first[first < len(values)]] = True
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep], values[keep]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end of the last one."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def pack(bucket: np.ndarray, owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob for each bucket: how many owners, the owners, how many items each has, then the columns."""
    if len(bucket) == 0:
        return
    own, place = np.unique(owner, return_inverse=True)
    order = np.argsort(bucket * len(own) + place)
    bucket, owner = bucket[order], owner[order]
    columns = tuple(c[order] for c in columns)
    edges = runs(bucket)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = runs(owner[a:b])
        head = np.array([len(own) - 1], dtype=np.int32).tobytes()
        parts = [head, owner[a:b][own[:-1]].astype(np.int64).tobytes(), np.diff(own).astype(np.int32).tobytes()]
        yield int(bucket[a]), b"".join(parts + [c[a:b].tobytes() for c in columns])


def unpack(blobs: list[bytes], *types: type) -> tuple[np.ndarray, ...]:
    """Owners and columns of many blobs, one after the other."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(types) + 1)]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int32, 1)[0])
        owners = np.frombuffer(blob, np.int64, n, 4)
        counts = np.frombuffer(blob, np.int32, n, 4 + 8 * n)
        at, total = 4 + 12 * n, int(counts.sum())
        out[0].append(np.repeat(owners, counts))
        for i, kind in enumerate(types):
            out[i + 1].append(np.frombuffer(blob, kind, total, at))
            at += total * np.dtype(kind).itemsize
    kinds = (np.int64, *types)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))
