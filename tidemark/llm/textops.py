"""Vectorised word and hash arithmetic over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; as these are ASCII, cutting the UTF-8 bytes is exact.
Hashes are polynomial over 64-bit integers with a random value per byte, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 2 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the worker's life (n is bounded by the longest slice)."""
    held = _powers.get(int(base))
    if held is None or len(held) <= n:
        held = np.full(max(n + 1, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        _powers[int(base)] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE) -> np.ndarray:
    """The hash of values[start:end] for each span; equal sequences have equal hashes wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse, n)[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a slice of documents, in order."""

    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # n + 1 byte offsets of the documents
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of each word's document
    first: np.ndarray  # n + 1 offsets of the documents in words
    _hash: np.ndarray | None = field(default=None)

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans_hash(BYTE[self.data], self.start, self.end)
        return self._hash

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum per document of one number for each word."""
        return cut_sum(flags, self.first)

    def bytes_per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum per document of one number for each byte."""
        return cut_sum(flags, self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def cut_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def split(column: pa.Array) -> Words:
    data, bounds = utf8(column)
    inside = ~SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    full = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[full] = True
    after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``size`` text bytes, a longer text alone, so that memory doesn't follow the batch."""
    for batch in batches:
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def window_hash(w: Words, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``width`` words inside one document."""
    count = len(w.start) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:count] == w.doc[width - 1 :])
    return spans_hash(w.hash ^ mix(np.full(1, salt, np.uint64)), at, at + width), at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; does an equal one stand earlier."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    many, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``width`` words that starts in ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1) if len(at) < 64 else edge.__iadd__(np.bincount(at, minlength=n + 1))
    ends = at + width
    edge -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:-1]) > 0
