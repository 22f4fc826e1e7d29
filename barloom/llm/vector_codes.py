"""Vectors as codes of codebook entries, the nearest entry found by a GNAT over each codebook.

Components are integers (``floor(256 x)``), so all distances that decide are exact.  A node of a geometric near-neighbour
access tree holds a few split points and, for each split point and each child, the least and greatest distance to the
child's entries.  A query at distance d from a split point, whose best entry so far lies at distance r, can skip a child
whose range does not meet [d - r, d + r].  Bounds are widened by more than the error of a square root, and a child is
skipped only if it lies strictly outside, so an entry at an equal distance and a lower number is still found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.readers import materialize

#: Parts of a vector, entries of a codebook, rounds of refinement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Split points of a node, entries of a leaf, components that a task looks up at once.
DEGREE, LEAF, BATCH = 8, 8, 1 << 20
#: Labels up to which their sums are broadcast.
BROADCAST = 100_000


class Gnat:
    """Nearest entries by squared Euclidean distance, ties to the lower number."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.compared = 0  # distances computed in all look-ups
        self.root = self._node(np.arange(len(points)))

    def _node(self, own: np.ndarray):
        if len(own) <= LEAF + DEGREE:
            return own
        # split points far from each other: each is the entry farthest from those before it
        splits = [0]
        near = self._squares(self.points[own], self.points[own[0]])
        while len(splits) < DEGREE:
            splits.append(int(near.argmax()))
            near = np.minimum(near, self._squares(self.points[own], self.points[own[splits[-1]]]))
        rest = np.setdiff1d(np.arange(len(own)), splits)
        if len(np.unique(splits)) < DEGREE or not len(rest):  # fewer different entries than split points
            return own
        squares = np.stack([self._squares(self.points[own], self.points[own[s]]) for s in splits])
        child = squares[:, rest].argmin(0)
        distances = np.sqrt(squares.astype(np.float64))
        groups = [rest[child == k] for k in range(DEGREE)]
        low = np.array([[row[g].min() if len(g) else np.inf for g in groups] for row in distances])
        high = np.array([[row[g].max() if len(g) else -np.inf for g in groups] for row in distances])
        return own[splits], low, high, [self._node(own[g]) if len(g) else None for g in groups]

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return (d * d).sum(-1)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry for each query."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.points))
        self._search(self.root, np.ascontiguousarray(queries.T), np.arange(len(queries)), best, index)
        return index, best

    def _compare(self, queries, rows, entry, best, index) -> np.ndarray:
        self.compared += len(rows)
        squares = np.zeros(len(rows), np.int64)
        for column, x in zip(queries, self.points[entry].tolist()):
            d = column[rows] - x
            squares += d * d
        better = (squares < best[rows]) | ((squares == best[rows]) & (entry < index[rows]))
        best[rows[better]] = squares[better]
        index[rows[better]] = entry
        return squares

    def _search(self, node, queries, rows, best, index) -> None:
        if isinstance(node, np.ndarray):
            for entry in node.tolist():
                self._compare(queries, rows, entry, best, index)
            return
        splits, low, high, children = node
        d = np.sqrt(np.stack([self._compare(queries, rows, s, best, index) for s in splits.tolist()]).astype(np.float64))
        order = d.argsort(0)
        for turn in range(len(children)):  # each query visits the children in order of their split points' distances
            for k, child in enumerate(children):
                mine = np.flatnonzero(order[turn] == k) if child is not None else ()
                if not len(mine):
                    continue
                r = np.sqrt(best[rows[mine]].astype(np.float64))
                gap = np.maximum(d[:, mine] - high[:, k:k + 1], low[:, k:k + 1] - d[:, mine])
                slack = 1e-9 * (d[:, mine] + high[:, k:k + 1] + r + 1)
                open_ = ~(gap - slack > r).any(0)
                if open_.any():
                    self._search(child, queries, rows[mine[open_]], best, index)


def sound(vector: Column, limit: float) -> Column:
    """Whether a vector has components, none of them null, not a number, or beyond ``limit``."""
    x = F.transform(vector, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < limit))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``floor(256 x)``."""
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * 256).astype(np.int64).reshape(-1, dim)


def kept(vectors: DataFrame, key: str, vector: str, parts: int, *others: str, dim: int = 0) -> tuple[DataFrame, int]:
    """The rows that can be coded, and their dimension (looked up unless given).

    Dropped are null and empty vectors, those with a null or non-finite component or one so large (2^22 / sqrt(dimension)
    and more) that squared distances would leave 64 bits, and those whose length is not a multiple of ``parts`` or not
    that of the row with the least key.  A null key comes after all others, equal keys in order of their vectors.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), *[F.col(c) for c in others])
    rows = rows.where(sound(F.col("vector"), float(1 << 22)) & (F.size("vector") % parts == 0))
    if not dim:
        first = rows.select("key", "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(1).collect()
        dim = len(first[0].vector) if first else 0
    return rows.where((F.size("vector") == dim) & sound(F.col("vector"), (1 << 22) / max(dim, 1) ** 0.5)), dim


def assign(codebooks: list[np.ndarray], values: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part and the squared distances summed over the parts."""
    codes, error = np.empty((len(values), len(codebooks)), np.int64), np.zeros(len(values), np.int64)
    width = codebooks[0].shape[1]
    for p, tree in enumerate(trees):
        codes[:, p], squares = tree.nearest(values[:, p * width:(p + 1) * width])
        error += squares
    return codes, error


def slices(batch: pa.RecordBatch, column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    size = max(1, BATCH // dim)
    for at in range(0, len(batch), size):
        part = batch.slice(at, size)
        yield part, integers(part.column(part.schema.get_field_index(column)), dim)


def refine(rows: DataFrame, dim: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes the rounded-down mean of the parts nearest to it.  A task sends its sums once, a row
    per part, entry and component; the driver gets as many rows in all as the codebooks have components."""
    width = dim // len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        sums = np.zeros((len(codebooks), len(codebooks[0]), width), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            for _, values in slices(batch, "vector", dim):
                codes, _ = assign(codebooks, values, trees)
                for p in range(len(codebooks)):
                    counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
                    for i in range(width):  # sums of a slice are below 2^53, so exact
                        sums[p, :, i] += np.bincount(codes[:, p], values[:, p * width + i], counts.shape[1]).astype(np.int64)
        part, entry = np.nonzero(counts)
        cells = ((part * counts.shape[1] + entry)[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.repeat(counts[part, entry], width)), pa.array(sums[part, entry].ravel())],
                                         ["cell", "n", "total"])

    found = rows.select("vector").mapInArrow(run, "cell bigint, n bigint, total bigint").groupBy("cell")
    out = np.stack(codebooks)
    flat = out.reshape(-1)
    for r in found.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        flat[r.cell] = int(r.total) // r.n  # rounds down
    return list(out)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries x components, integers) per part.  They start as the parts of the rows with the least keys,
    fewer than ``entries`` if there are fewer rows; no rows, no codebooks."""
    rows, dim = kept(vectors, key, vector, parts)
    if not dim:
        return []
    first = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    start = np.floor(np.array([r.vector for r in first], np.float64) * 256).astype(np.int64)
    codebooks = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        codebooks = refine(rows, dim, codebooks)
    return codebooks


def encode(vectors: DataFrame, codebooks: list[np.ndarray], *others: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``others``, the key, code (the entries in part order, two hex digits each, four beyond 256 entries) and error (the
    squared distances summed) per row that can be coded.  Equal rows give equal rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*others, key).schema)
    schema += ", code string, error bigint"
    if not codebooks:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, dim = kept(vectors, key, vector, len(codebooks), *others, dim=len(codebooks) * codebooks[0].shape[1])
    digits = 2 if len(codebooks[0]) <= 256 else 4
    names = [*others, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        for batch in batches:
            for part, values in slices(batch, "vector", dim):
                codes, error = assign(codebooks, values, trees)
                hexes = codes.astype(np.uint8 if digits == 2 else ">u2").tobytes().hex()
                step = digits * len(codebooks)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], pa.array([hexes[i:i + step] for i in range(0, len(hexes), step)], pa.string()),
                                                  pa.array(error)], [*names, "code", "error"])

    return rows.select(*others, F.col("key").alias(key), "vector").mapInArrow(run, schema)


def decode(codes: DataFrame, codebooks: list[np.ndarray], code: str = "code") -> DataFrame:
    """Adds ``vector``, the entries of the code divided by 256; null for a null code."""
    digits = 2 if not codebooks or len(codebooks[0]) <= 256 else 4
    books = F.array(*[F.array(*[F.array(*[F.lit(x / 256) for x in entry]) for entry in book.tolist()]) for book in codebooks])
    index = [F.conv(F.substring(code, digits * p + 1, digits), 16, 10).cast("int") for p in range(len(codebooks))]
    return codes.withColumn("vector", F.when(F.col(code).isNotNull(), F.concat(*[F.get(F.get(books, F.lit(p)), i) for p, i in enumerate(index)])))


def fingerprint(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def digest(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Codes and errors of all rows, with the error summed per label (nulls together; null beyond 64 bits)."""
    codebooks = train(vectors)
    coded = materialize(encode(vectors, codebooks, label), "codes")
    sums = materialize(coded.groupBy(label).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed(label, "_label"), "sums")
    if sums.limit(BROADCAST + 1).count() <= BROADCAST:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The digest with every part compared with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(s) AS s, any_value(label) AS label
       FROM (SELECT x.*, b.entry, list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - b.s[i]) * (x.s[i] - b.s[i]))) AS d FROM p x JOIN b{r} b ON b.part = x.part)
       GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT part, entry, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM a{r})
       GROUP BY part, entry, i),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(n.s, b.s) AS s FROM b{r} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS s FROM m{r} GROUP BY part, entry) n
       ON n.part = b.part AND n.entry = b.entry)""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS s FROM k, (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}),
{(',' + chr(10)).join(steps)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c"""
