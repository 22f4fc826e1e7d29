"""Documents linked by the Jaccard similarity of their word shingles, and the components of the links.

Sets are points of a metric space (distance = 1 - similarity).  A document is a pivot's candidate if the two share one of
their rarest shingles, as many of them as a linked document can lack and one more.  Every shingle names as its pivot the
least of the sets that have it among their rarest, so two linked sets are candidates of the same pivot; a pivot with its
candidates is a region.  Regions are bounded by what lies around one document, not by chains of candidates.

A region is cut by distances.  What lies within the radius of a pivot is linked to it; what lies within two radii stays in
the pivot's cell, as by the triangle inequality a partner of what is linked can't lie farther; the rest forms a cell of its
own.  Cells are cut again until one task can compare them.  Only verified links form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.blocks import squeeze, unsqueeze
from barloom.llm.components import components
from barloom.llm.words import bounded, mix, shingles, words
from barloom.sources.readers import discard, materialize

#: Words of a shingle, least similarity in percent, shingles of a region that one task takes, pivots, members compared pair by pair.
SHINGLE, PERCENT, REGION, PIVOTS, SMALL = 3, 90, 1 << 21, 16, 24
#: Bits of the table that tells rare shingles from frequent ones; it decides the order of pivots, not the result.
SLOTS = 24
#: Rows of three numbers or fewer up to which a side of a join is broadcast.
BROADCAST = 250_000
#: Buckets of a set's histogram, and pairs of histograms that a task compares for one region.
BUCKETS, PAIRS = 256, 1 << 22
#: Rounds in which regions above the limit are cut, as long as each leaves at most such a share of the shingles in cells above
#: it; what is left is compared part by part.
ROUNDS, SHRINK = 8, 0.7


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, sorted; fewer words than a shingle make up one."""
    w = words(column, lower=True)
    every = shingles(w.hashes, size)
    for a, b in zip(w.bounds.tolist(), w.bounds[1:].tolist()):
        yield np.unique(every[a:b - size + 1] if b - a >= size else mix(shingles(w.hashes[a:b], b - a) + np.uint64(b - a)) if b > a else every[:0])


def set_hash(members: np.ndarray) -> int:
    """One number for a set."""
    return int((mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ mix(np.array([len(members)], np.uint64))[0]).view(np.int64))


def rarest(members: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The set's first elements in a fixed order of all elements, rare ones first.

    Of n elements a linked set lacks at most (1 - s) n.  So the first common element of two linked sets lies, in each of
    them, among the first (1 - s) n + 1.  ``counts`` only has to be the same for all sets.
    """
    order = np.lexsort((mix(members), counts[(members >> np.uint64(64 - SLOTS)).astype(np.int64)]))
    return members[order[:len(members) * (100 - percent) // 100 + 1]]


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets of all documents have an element in each of 2^SLOTS slots, on a logarithmic scale: a table of fixed
    size.  Tasks add up in groups first, so no addition takes more tables than the root of their number or so."""
    chunk, groups = 1 << 16, 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.uint32)
        for batch in bounded(batches, 1 << 22):
            found = list(shingle_sets(batch.column(0), size))
            if found:
                slot, n = np.unique(np.concatenate(found) >> np.uint64(64 - SLOTS), return_counts=True)
                total[slot.astype(np.int64)] += n.astype(np.uint32)
        parts = [(k, squeeze(part.astype(np.uint64))) for k, part in enumerate(total.reshape(-1, chunk)) if part.any()]
        columns = list(zip(*parts)) or [(), ()]
        group = np.full(len(parts), TaskContext.get().partitionId() % groups)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(group, pa.int64())], ["chunk", "counts", "part"])

    def summed(table: pa.Table) -> np.ndarray:
        return sum((unsqueeze(x.as_py(), chunk, np.uint64) for x in table["counts"]), np.zeros(chunk, np.uint64))

    def add(table: pa.Table) -> pa.Table:
        return pa.table([table["chunk"][:1], pa.array([squeeze(summed(table))], pa.binary())], names=["chunk", "counts"])

    def finish(table: pa.Table) -> pa.Table:
        scaled = np.minimum(np.log2(1.0 + summed(table)) * 1024, 0xFFFF).astype(np.uint16)
        return pa.table([table["chunk"][:1], pa.array([squeeze(scaled)], pa.binary())], names=["chunk", "counts"])

    counts = np.zeros(1 << SLOTS, np.uint16).reshape(-1, chunk)
    rows = docs.mapInArrow(run, "chunk bigint, counts binary, part bigint").groupBy("chunk", "part").applyInArrow(add, "chunk bigint, counts binary")
    for row in rows.groupBy("chunk").applyInArrow(finish, "chunk bigint, counts binary").collect():  # one row per chunk of the table
        counts[row.chunk] = unsqueeze(row.counts, chunk, np.uint16)
    return counts.reshape(-1)


def sets(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, row (a key of id and text), n_shingles and node (a hash of the set; null for an empty one) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 22):
            found = list(shingle_sets(batch.column(2), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([set_hash(x) if len(x) else None for x in found], pa.int64())],
                ["doc_id", "row", "n_shingles", "node"])

    return docs.select("doc_id", row_key(text).alias("row"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, node bigint")


def row_key(text: str = "text") -> Column:
    """Tells rows apart, also those without an id; rows equal in id and text share it."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def candidates(docs: DataFrame, size: int, percent: int, text: str = "text") -> DataFrame:
    """(u, v): the sets u that share one of their rarest shingles with the pivot v, for the least set of each shingle.

    Rows (shingle, node) are sorted within partitions, and each node meets the first one of its shingle, so any number of
    sets pass through as a stream and make one row each.  Near copies name the same pivot for most of their shingles.
    """
    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(rows, size))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 22):
            keys, nodes, seen = [], [], set()
            for members in shingle_sets(batch.column(0), size):
                node = set_hash(members)
                if len(members) and node not in seen:
                    seen.add(node)
                    own = rarest(members, counts.value, percent)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))], ["key", "node"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, 0
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = keys[0] != key
            leads = np.where(new, nodes, 0)
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            leads = np.where(first >= 0, nodes[np.maximum(first, 0)], lead)
            key, lead = keys[-1], leads[-1]
            pairs = np.unique(np.stack([nodes, leads], 1)[nodes != leads], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    rows = rows.mapInArrow(emit, "key bigint, node bigint")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(stars, "u bigint, v bigint").distinct()


class Region:
    """Sets that one task compares."""

    def __init__(self, members: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(x) for x in members], np.int64)
        self.at = np.cumsum(self.n) - self.n
        values, self.flat = np.unique(np.concatenate(members), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)
        self.links: list[tuple[int, int]] = []
        self.root = np.arange(len(members))

    def shared(self, one: int, many: np.ndarray) -> np.ndarray:
        """Elements that a set shares with each of others."""
        own = self.flat[self.at[one]:self.at[one] + self.n[one]]
        self.mark[own] = 1
        ends = np.cumsum(self.n[many])
        index = np.arange(ends[-1]) + np.repeat(self.at[many] - ends + self.n[many], self.n[many])
        out = np.add.reduceat(self.mark[self.flat[index]], ends - self.n[many])
        self.mark[own] = 0
        return out.astype(np.int64)

    def linked(self, one: int, many: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (self.n[one] + self.n[many] - shared)

    def distance(self, one: int, many: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return 1 - shared / (self.n[one] + self.n[many] - shared)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def link(self, one: int, many: np.ndarray) -> None:
        for other in many.tolist():
            a, b = self.find(one), self.find(other)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((one, other))

    def solve(self, part: np.ndarray, radius: float) -> None:
        """Links that connect what is linked among the members of ``part``."""
        eps = 1e-9
        while len(part) > SMALL:
            pivots = part[np.linspace(0, len(part) - 1, PIVOTS).astype(int)]
            d = np.empty((PIVOTS, len(part)))
            for k, p in enumerate(pivots.tolist()):
                shared = self.shared(p, part)
                d[k] = self.distance(p, part, shared)
                self.link(p, part[self.linked(p, part, shared)])
            cells = d <= d.min(0) + 2 * radius + eps
            nearest = d.argmin(0)
            sizes = cells.sum(1)
            if sizes.max() <= 0.7 * len(part):
                for k in np.unique(nearest).tolist():  # a cell without members of its own has no pair to find
                    self.solve(part[cells[k]], radius)
                return
            # no pivot tells the members apart: either a dense core, or sets that share too little for pivots
            k = int((d <= radius + eps).sum(1).argmax())
            if (d[k] <= radius + eps).sum() < 0.3 * len(part):
                self.by_prefixes(part)
                return
            # the core is linked to the pivot and needs no more pairs; those outside are compared with it
            p = int(pivots[k])
            core = self.linked(p, part, self.shared(p, part))
            inside, rest, dc = part[core], part[~core], d[k]
            for x in np.flatnonzero(~core & (dc <= 2 * radius + eps)).tolist():
                one = int(part[x])
                if self.find(one) == self.find(p):
                    continue
                window = inside[np.abs(dc[core] - dc[x]) <= radius + eps]
                if len(window):
                    shared = self.shared(one, window)
                    self.link(one, window[self.linked(one, window, shared)][:1])
            part = rest
        self.by_pairs(part)

    def by_prefixes(self, part: np.ndarray) -> None:
        """Sets in order of size, each compared with those that share one of its rarest elements: of n elements at most
        (1 - s) n can be missing from the other set, so with one element more there is a common one."""
        order = part[np.argsort(self.n[part], kind="stable")]
        rarity = np.argsort(np.argsort(np.bincount(self.flat, minlength=len(self.mark)), kind="stable"))
        holders: dict[int, list[int]] = {}
        for one in order.tolist():
            n = int(self.n[one])
            own = self.flat[self.at[one]:self.at[one] + n]
            keys = own[np.argpartition(rarity[own], min(n - 1, n * (100 - self.percent) // 100))[:n * (100 - self.percent) // 100 + 1]].tolist()
            near = {o for key in keys for o in holders.get(key, ()) if 100 * self.n[o] >= self.percent * n}
            mine = self.find(one)
            others = np.array([o for o in near if self.find(o) != mine], np.int64)
            if len(others):
                shared = self.shared(one, others)
                self.link(one, others[self.linked(one, others, shared)])
            for key in keys:
                holders.setdefault(key, []).append(one)

    def by_pairs(self, part: np.ndarray) -> None:
        for k in range(len(part) - 1):
            others = part[k + 1:]
            others = others[[self.find(o) != self.find(int(part[k])) for o in others.tolist()]]
            if len(others):
                shared = self.shared(int(part[k]), others)
                self.link(int(part[k]), others[self.linked(int(part[k]), others, shared)])


def points(docs: DataFrame, wanted: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(node, n, histogram, shingles) for the rows (row, node) of ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 22):
            found, nodes = list(shingle_sets(batch.column(1), size)), batch.column(0).to_pylist()
            keep = [i for i, (x, node) in enumerate(zip(found, nodes)) if len(x) and set_hash(x) == node]  # two rows may share a key
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.int64()), pa.array([len(found[i]) for i in keep], pa.int64()),
                                              pa.array([histogram(found[i]) for i in keep], pa.binary()), pa.array([found[i].tobytes() for i in keep], pa.binary())],
                                             ["node", "n", "histogram", "shingles"])

    rows = docs.select(row_key(text).alias("row"), F.col(text).alias("text")).join(wanted, "row")
    return rows.select("node", "text").mapInArrow(run, "node bigint, n bigint, histogram binary, shingles binary")


def histogram(members: np.ndarray) -> bytes:
    """How many elements fall into each of BUCKETS buckets, a byte each; empty if one has more than 255."""
    counts = np.bincount((members & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def possible(n: np.ndarray, histograms: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a region may be linked to another one.  Two sets share at most the sum of their buckets' lesser
    counts, so no link is lost; sets without a histogram, and regions with too many pairs of like size, stay as they are."""
    order = np.argsort(n, kind="stable")
    size = n[order]
    last = np.searchsorted(size, size * 100 // percent, "right")
    if (last - np.arange(len(n)) - 1).sum() > PAIRS or any(not h for h in histograms):
        return np.ones(len(n), bool)
    table = np.frombuffer(b"".join(histograms), np.uint8).reshape(-1, BUCKETS)[order]
    alive = np.zeros(len(n), bool)
    for i, end in enumerate(last.tolist()):
        if end > i + 1:
            shared = np.minimum(table[i], table[i + 1:end]).sum(1, dtype=np.int64)
            near = 100 * shared >= percent * (size[i] + size[i + 1:end] - shared)
            alive[i] |= near.any()
            alive[i + 1:end] |= near
    out = np.empty(len(n), bool)
    out[order] = alive
    return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with an equal first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def compatible(members: DataFrame, percent: int) -> DataFrame:
    """Members (region, node, n) in regions cut where sizes differ too much for any link, without those left alone."""
    by_size = Window.partitionBy("region").orderBy("n", "node")
    gap = F.when(100 * F.lag("n").over(by_size) >= percent * F.col("n"), 0).otherwise(1)
    cut = members.withColumn("gap", gap).withColumn("cut", F.sum("gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("many", F.count("*").over(Window.partitionBy("region", "cut"))).where("many > 1")
    return cut.select(F.xxhash64("region", "cut").alias("region"), "node", "n")


def promising(members: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """The members (region, node) that histograms do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for table in runs(batches):
            alive = possible(table["n"].to_numpy(), table["histogram"].to_pylist(), percent)
            if alive.any():
                held.append(table.select(["region", "node"]).filter(pa.array(alive)))
            if sum(len(x) for x in held) > 4096:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    rows = sets_of.select("node", "n", "histogram").join(members.select("region", "node"), "node").select("region", "node", "n", "histogram")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region bigint, node bigint")


def join_regions(members: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect what is linked inside the regions of ``members`` (region, node), each small enough for a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            nodes = table["node"].to_numpy()
            _, first = np.unique(nodes, return_index=True)
            if len(first) < 2:
                continue
            region = Region([np.frombuffer(x, np.uint64) for x in table["shingles"].take(pa.array(first)).to_pylist()], percent)
            region.solve(np.arange(len(first)), 1 - percent / 100)
            if region.links:
                pairs = nodes[first][np.array(region.links, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    rows = sets_of.select("node", "shingles").join(members.select("region", "node"), "node").select("region", "node", "shingles")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "u bigint, v bigint")


def cut_regions(members: DataFrame, sets_of: DataFrame, percent: int, limit: int, level: int) -> DataFrame:
    """(region, node, n, pivot, distance) of one round: the pivot's cell and the distance to it, or the cell of all that no
    pivot is linked to (pivot null).

    A region's pivots are the sets of least hash in PIVOTS classes, found by minima.  A region is dealt out in parts of
    about ``limit`` shingles; each part gets the pivots once, ahead of its members, so a task holds the pivots of one part
    and a region of any size runs on many tasks.
    """
    radius = 1 - percent / 100
    n_parts = F.ceil(F.sum("n") / limit).cast("int")
    sizes = members.groupBy("region").agg(n_parts.alias("parts"))
    draw = F.struct(F.xxhash64("node", F.lit(2 * level + 1)).alias("h"), "node")
    chosen = members.groupBy("region", F.pmod(F.xxhash64("node", F.lit(2 * level)), F.lit(PIVOTS)).alias("class")).agg(F.min(draw).alias("p"))
    pivots = chosen.join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("p.node").alias("node"))
    own = members.join(sizes, "region").select("region", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "node")
    rows = pivots.unionByName(own).join(sets_of, "node").select(F.xxhash64("region", "part").alias("task"), "region", "kind", "node", "n", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "node", "n", "pivot", "distance"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        task, pivots = None, {}
        for batch in batches:
            out = []
            columns = [batch.column(i).to_numpy() for i in range(5)]
            for i, (t, region, kind, node, n) in enumerate(zip(*(c.tolist() for c in columns))):
                own = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                if t != task:
                    task, pivots = t, {}
                if kind == 0:
                    pivots[node] = own.copy()
                    continue
                linked = False
                for p, theirs in pivots.items():
                    shared = len(np.intersect1d(own, theirs, assume_unique=True))
                    distance = 1 - shared / (len(own) + len(theirs) - shared)
                    if distance <= 2 * radius + 1e-9:
                        near = 100 * shared >= percent * (len(own) + len(theirs) - shared)
                        linked |= near
                        out.append((cell(region, p), node, n, p, -1 - distance if near else distance))  # linked ones below zero
                if not linked:
                    out.append((cell(region, level), node, n, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names)

    return rows.repartition("task").sortWithinPartitions("task", "kind").mapInArrow(run, "region bigint, node bigint, n bigint, pivot bigint, distance double")


def cell(region: int, which: int) -> int:
    return int(mix(np.array([region, which], np.int64).view(np.uint64) * np.array([1, 3], np.uint64)).sum(dtype=np.uint64).view(np.int64))


def join_large(members: DataFrame, sets_of: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Members (region, node, n) of regions above ``limit`` shingles: (edges found on the way, cells that one task takes).

    After each round cells whose members are all connected are dropped, and in the others those linked to the pivot that
    lie too far inside for a partner among the rest.  What the rounds leave is dealt out as pairs of parts.
    """
    radius = 1 - percent / 100
    edges, cells, before = None, [], members.agg(F.sum("n")).first()[0]
    for level in range(1, ROUNDS + 1):
        found = materialize(cut_regions(members, sets_of, percent, limit, level), "cells")
        linked = found.where("distance < 0 and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        edges = materialize(linked if edges is None else edges.unionByName(linked), "links")
        roots = small(components(edges))
        open_ = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spans = open_.groupBy("region").agg(F.min(F.when(F.col("distance") >= 0, F.col("distance"))).alias("outer"), F.min("root").alias("a"), F.max("root").alias("b"))
        open_ = open_.join(spans.where("a <> b").select("region", "outer"), "region")
        inside = F.coalesce(-1 - F.col("distance") < F.col("outer") - radius - 1e-9, F.lit(False)) & (F.col("distance") < 0)
        open_ = materialize(open_.where(~inside).select("region", "node", "n"), "members")
        counts = materialize(open_.groupBy("region").agg(F.sum("n").alias("size")), "sizes")
        cells.append(compatible(open_.join(counts.where(F.col("size") <= limit), "region", "left_semi"), percent))
        large = counts.where(F.col("size") > limit)
        left = large.agg(F.sum("size")).first()[0]
        if not left:
            break
        if level == ROUNDS or left > SHRINK * before:
            own = open_.join(large, "region")
            parts = F.ceil(F.col("size") * 3 / limit).cast("int")
            own = own.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            cells.append(own.select(F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other")).alias("region"), "node", "n"))
            break
        members, before = open_.join(large, "region", "left_semi"), left
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more)
    return edges, out


def links(docs: DataFrame, known: DataFrame, size: int, percent: int, limit: int) -> DataFrame:
    """Verified edges (u, v) between sets that connect all that is linked."""
    stars = materialize(candidates(docs, size, percent), "stars")
    members = stars.select(F.col("v").alias("region"), F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("region"), F.col("v").alias("node")).distinct())
    holders = known.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"))
    members = materialize(members.join(holders.select("node", "n"), "node").select("region", "node", "n"), "members")
    counts = materialize(members.groupBy("region").agg(F.sum("n").alias("size")), "sizes")
    large = counts.where(F.col("size") > limit)
    heavy = bool(large.limit(1).count())
    rest = materialize(compatible(members.join(large, "region", "left_anti") if heavy else members, percent), "regions")
    wanted = rest.select("node")
    if heavy:
        wanted = wanted.unionByName(members.join(large, "region", "left_semi").select("node"))
    wanted = holders.join(wanted.distinct(), "node").select("row", "node")
    found = points(docs, small(wanted), size)
    if known.where("node is not null").groupBy("row").count().where("count > 1").limit(1).count():  # repeated rows
        found = found.dropDuplicates(["node"])
    found = materialize(found, "points")
    edges = join_regions(small(promising(small(rest), found, percent)), found, percent)
    if heavy:
        linked, cells = join_large(members.join(large, "region", "left_semi"), found, percent, limit)
        edges = edges.unionByName(linked).unionByName(join_regions(small(promising(small(cells), found, percent)), found, percent))
    edges = materialize(edges, "links")
    discard(stars, members, found)
    return edges


def clustered(docs: DataFrame, size: int, percent: int, limit: int, text: str) -> DataFrame:
    """doc_id, row, n_shingles and root (null without a set; equal for what links connect) per row."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    known = materialize(sets(docs, size), "sets")
    linked = components(links(docs, known, size, percent, limit))
    return materialize(known.join(linked, "node", "left").select("doc_id", "row", "n_shingles", F.coalesce("root", "node").alias("root")), "clustered")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, limit: int = REGION, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id per row of docs.

    Words are lower-cased (A-Z); a document's set holds its distinct runs of ``size`` words, or the whole sequence if it
    has fewer.  Two documents are linked if ``100 * intersection >= percent * union``; component_id is the least doc_id
    that links reach.  Null and empty texts have no set and no link.  Equal sets are one node, so copies cost nothing
    beyond a row each.  A null doc_id has no part in the minimum and takes the component of its set, null if no document
    with an id is reached.
    """
    rooted = clustered(docs, size, percent, limit, text)
    # written, so that the join can split a component that holds many documents
    least = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def small(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most BROADCAST rows; else joins shuffle both sides."""
    rows = materialize(rows, "small")
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, limit: int = REGION, text: str = "text") -> DataFrame:
    """One row of each component, as it is: that with the least doc_id, a null one last, then by a hash of the text.

    Rows are judged one by one, so rows of one doc_id with unlike texts stay each.  Rows equal in doc_id and text are one
    document and leave one row.  Rows without words stay.
    """
    rooted = clustered(docs, size, percent, limit, text)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    least = materialize(rooted.where("root is not null").groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows"), F.count_distinct("row").alias("different")), "least")
    late = rooted.join(least.where("rows > 1").select("root", F.col("best.row").alias("best")), "root").where("row <> best")
    late = small(late.select(F.col("row").alias("_late")).distinct())
    key = row_key(text)
    kept = docs.join(late, key == late["_late"], "left_anti")
    repeated = least.where("rows > different")
    if not repeated.limit(1).count():
        return kept
    again = rooted.join(repeated.select("root"), "root", "left_semi").groupBy("row").count().where("count > 1")
    again = small(again.select(F.col("row").alias("_again")))
    twice = kept.join(again, key == again["_again"], "left_semi")
    single = twice.dropDuplicates(["doc_id", text])
    return kept.join(again, key == again["_again"], "left_anti").unionByName(single)
