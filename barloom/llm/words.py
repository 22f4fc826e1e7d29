"""Words of whole Arrow text columns as 64-bit hashes, without Python objects per word.

A word is a run of bytes other than space and \\t..\\r.  Equal words have equal hashes; two different words collide with
probability 2^-64.  Nulls count as empty texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_values(lower: bool, white: np.ndarray) -> np.ndarray:
    b = np.arange(256)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
    values = mix((b.astype(np.uint64) + np.uint64(1)) * ODD)
    values[white] = 0
    return values


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, all documents one after another
    bounds: np.ndarray  # int64, len(docs) + 1: the words of document i are bounds[i]:bounds[i + 1]
    starts: np.ndarray  # int64, first byte of each word in data
    data: np.ndarray  # uint8, the texts one after another

    def document(self) -> np.ndarray:
        """The document's number for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array, lower: bool = False, white: np.ndarray = SPACE, head: int | None = None) -> Words:
    """``white``: which bytes lie between words; ``head``: hash only so many bytes of each word."""
    data, at = texts(column)
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), data)
    space = white[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), starts, data)
    ends = np.append(starts[1:], n)
    within = np.arange(n, dtype=np.int64)
    within[starts[0]:] -= np.repeat(starts, ends - starts)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((ends - starts).max()) + int(starts[0]), ODD)]), dtype=np.uint64)
    values = _byte_values(lower, white)[data]
    values *= powers[within]
    if head is not None:
        values[within >= head] = 0
    return Words(mix(np.add.reduceat(values, starts)), np.searchsorted(starts, at).astype(np.int64), starts, data)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by position; runs may reach over a document's end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= ODD
        out += hashes[k:k + n]
    return mix(out)


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which of all runs of ``size`` words lie in one document."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    starts = np.arange(n)
    end = bounds[np.searchsorted(bounds, starts, "right")]
    return starts + size <= end


def bounded(frames, limit: int, text: str = "text"):
    """Arrow batches cut into slices of at most ``limit`` text bytes, one document at least."""
    for batch in frames:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, first = 0, 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(size)
        if first < len(sizes):
            yield batch.slice(first)
