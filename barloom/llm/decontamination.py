"""Passages of a benchmark in documents, by SimHash over windows as long as the items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import bounded, mix, shingles, words

#: Words of a shingle, least similarity, bits that two fingerprints may differ in, bytes of a benchmark's text per task.
SHINGLE, SIMILARITY, RADIUS, ITEMS = 5, 0.8, 20, 1 << 22
BITS = 64


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """The signs of 64 sums as one number."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint64).reshape(sums.shape[:-1])


def signs(hashes: np.ndarray) -> np.ndarray:
    """Each bit of a hash as +1 or -1."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


class HammingIndex:
    """Fingerprints in radius + 1 blocks of bits.  Two that differ in at most ``radius`` bits agree in one block at
    least, so looking up every block finds all of them."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:]) if b > a]
        self.tables = []
        for shift, mask in self.blocks:
            value = prints >> shift & mask
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, print) within the radius."""
        found = []
        for (shift, mask), (values, order) in zip(self.blocks, self.tables):
            wanted = queries >> shift & mask
            a, b = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = b - a
            q = np.repeat(np.arange(len(queries)), n)
            p = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
            close = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            found.append(q[close].astype(np.int64) << 32 | p[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs >> 32, pairs & 0xFFFFFFFF


class Items:
    """Benchmark items: their words and weighted shingles, and an index of fingerprints per item length."""

    def __init__(self, ids: list[int], texts: list[str], size: int, radius: int):
        self.size = size
        w = words(pa.array(texts, pa.string()), lower=True)
        parts = [(i, w.hashes[a:b]) for i, a, b in zip(ids, w.bounds, w.bounds[1:]) if b > a]
        self.ids = np.array([i for i, _ in parts], np.int64)
        self.lengths = np.array([len(x) for _, x in parts], np.int64)
        self.bags = [np.unique(item_shingles(x, size), return_counts=True) for _, x in parts]
        every = np.concatenate([b[0] for b in self.bags]) if parts else np.zeros(0, np.uint64)
        self.shingles = np.unique(every)
        # the lengths of the items that hold a shingle, by the shingle's own length
        long = np.repeat(self.lengths, [len(b[0]) for b in self.bags]) if parts else np.zeros(0, np.int64)
        self.owners = {}
        for k in np.unique(np.minimum(long, size)).tolist():
            own = np.minimum(long, size) == k
            order = np.lexsort((long[own], every[own]))
            keys, lengths = every[own][order], long[own][order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1])
            self.owners[k] = keys[new], lengths[new]
        self.by_length = {}
        for n in np.unique(self.lengths).tolist():
            members = np.flatnonzero(self.lengths == n)
            prints = np.array([fingerprints((signs(mix(self.bags[m][0])).T @ self.bags[m][1]).astype(np.int64)) for m in members], np.uint64)
            self.by_length[n] = (members, HammingIndex(prints, radius))


def item_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Runs of ``size`` words; fewer words make up one shingle."""
    return shingles(hashes, min(size, len(hashes)))


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def search(hashes: np.ndarray, items: Items, similarity: float) -> Iterator[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window per item in one document; the first of equal ones.

    A window that shares no shingle with an item has similarity 0, so only windows that hold a shingle of an item of
    their length are fingerprinted.  A document shorter than the item is one window; one with too few shingles for the
    similarity is passed over.
    """
    for of_item, k, sh, hit in hits(hashes, items):
        members, index = items.by_length[of_item]
        n = min(of_item, len(hashes))
        span = n - k + 1  # shingles of a window
        if span < similarity * (of_item - k + 1):
            continue
        # windows that hold a hit start at hit - span + 1 .. hit; neighbouring ones form stretches
        first = np.maximum(hit - span + 1, 0)
        last = np.minimum(hit, len(hashes) - n)
        best: dict[int, tuple[float, int]] = {}
        for a, b in stretches(first, last):
            for start in range(a, b + 1, 1 << 14):
                stop = min(b + 1, start + (1 << 14))
                rolled = np.cumsum(np.concatenate([np.zeros((1, BITS), np.int32), signs(mix(sh[start:stop + span - 1]))]), axis=0, dtype=np.int32)
                prints = fingerprints(rolled[span:] - rolled[:-span])
                for q, p in zip(*(x.tolist() for x in index.near(prints))):
                    window = np.unique(sh[start + q:start + q + span], return_counts=True)
                    score = weighted_similarity(window, items.bags[members[p]])
                    if score >= similarity and score > best.get(members[p], (0.0, 0))[0]:
                        best[members[p]] = (score, start + q)
        for m, (score, at) in best.items():
            yield int(items.ids[m]), at, n, score


def hits(hashes: np.ndarray, items: Items) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per item length: (item words, shingle words, the document's shingles, those that items of that length hold)."""
    for k, (keys, lengths) in items.owners.items():
        sh = shingles(hashes, k)
        a, b = np.searchsorted(keys, sh, "left"), np.searchsorted(keys, sh, "right")
        count = b - a
        at = np.repeat(np.arange(len(sh)), count)
        length = lengths[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
        for n in np.unique(length).tolist():
            yield n, k, sh, at[length == n]


def stretches(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
    """Unions of intervals that are sorted by both ends."""
    cut = np.flatnonzero(first[1:] > last[:-1] + 1) + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(first)]]).tolist()):
        if last[b - 1] >= first[a]:
            yield int(first[a]), int(last[b - 1])


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) with first_word, n_words and similarity of the document's best window for the item.

    Windows have as many words as the item (a document with fewer words is one window), words are compared without A-Z case, and similarity is the weighted Jaccard
    similarity of ``size``-word shingles with their counts as weights.  A pair is reported if a window's fingerprint lies
    within ``radius`` bits of the item's and its similarity is ``similarity`` or more.  Items and documents that are null
    or have no word match nothing; an item of fewer than ``size`` words is one shingle.  Repeated rows of documents give
    repeated pairs; repeated items count once per row.

    The benchmark is dealt into parts of at most ITEMS bytes (a single longer item is a part); each part is one broadcast
    value, and the documents are searched against each part in turn.
    """
    session = docs.sparkSession
    sized = benchmark.where("text is not null").select("item_id", "text")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-int(total) // ITEMS))
    chosen = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    out = None
    for part in range(n_parts):
        rows = (sized if n_parts == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part)).orderBy("item_id", "text").collect()  # about ITEMS bytes
        items = session.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], size, radius))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            wanted = items.value
            least = min(int(wanted.lengths.min()), size) if len(wanted.lengths) else size
            for batch in bounded(batches, 1 << 22):
                w = words(batch.column(1), lower=True)
                ids = batch.column(0).to_pylist()
                candidates = holders(w, wanted, least)
                found = [(ids[d], *x) for d in candidates for x in search(w.hashes[w.bounds[d]:w.bounds[d + 1]], wanted, similarity)]
                columns = list(zip(*found)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        pairs = chosen.mapInArrow(run, "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def holders(w, items: Items, least: int) -> list[int]:
    """Documents with a shingle of the benchmark."""
    found: set[int] = set()
    for k in range(least, items.size + 1):
        if k < items.size and not (items.lengths == k).any():
            continue
        sh = shingles(w.hashes, k)
        hit = np.flatnonzero(np.isin(sh, items.shingles))
        found.update((np.searchsorted(w.bounds, hit, "right") - 1).tolist())
    return sorted(found)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a pair in ``leaks``.  Rows are judged by a 64-bit key of doc_id and text, so rows with
    one doc_id, or with none, are judged each by its own text."""
    key = F.xxhash64(docs["doc_id"], docs[text])
    found = leaks(docs.select(key.alias("doc_id"), F.col(text).alias("text")), benchmark, size, similarity, radius)
    found = found.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, key == found["_leak"], "left_anti")
