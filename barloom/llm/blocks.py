"""Documents in blocks of bounded size, and sorted arrays as compact binary values.

An operator that needs one value per word of the corpus would move many bytes per word as rows.  Instead a task takes a
block of documents, sends one packed array per (block, group), and gets one array back in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_of(n_blocks: int, *columns: str) -> Column:
    """A block number that spreads equal keys, nulls included, unless whole rows are equal."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_blocks))


def in_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Adds ``block``; rows of one block meet in one task, so n_blocks should follow the corpus size."""
    return docs.withColumn("block", block_of(n_blocks, *[c for c in docs.columns]))


def squeeze(values: np.ndarray) -> bytes:
    """Fixed-width values as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unsqueeze(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value first."""
    return np.diff(values, prepend=values.dtype.type(0))


def undeltas(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def distinct_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit values, where each is first found, and which of them each value is.

    Sorts the high bits with the position in the low ones, which is several times faster than an indirect sort; values that
    share all their high bits are put in order afterwards.
    """
    n = len(values)
    low = np.uint64(max(1, n).bit_length())
    packed = (values >> low << low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = values[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        high = found >> low
        runs = np.unique(high[wrong])
        spans = zip(np.searchsorted(high, runs), np.searchsorted(high, runs, "right"))
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        order[at] = order[at[np.lexsort((order[at], found[at]))]]
        found[at] = values[order[at]]
    new = np.ones(n, bool)
    new[1:] = found[1:] != found[:-1]
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return found[new], order[new], which


def doc_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer ids; a null id counts as the largest number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def sample(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """About ``size`` rows, at most twice as many, chosen by the hash of ``key``; all of them if there are fewer.

    A count and a filter: no sort, and no task sends more than it keeps.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(*key), 1) < F.lit(int(size / n * (1 << 63)))).limit(2 * size)
