"""Connected components of a graph given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.readers import discard, materialize


def _stars(edges: DataFrame, low_only: bool) -> DataFrame:
    """Links the neighbours of each node to the least of them and itself: the greater neighbours only (large star), or
    the lesser ones and the node (small star).  Minima combine before the shuffle; no neighbourhood is collected."""
    both = edges if low_only else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if low_only:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v) of integers; root is the component's least node, and every node
    but the roots has a row.  Alternates large and small stars until nothing changes, which takes a number of rounds
    that grows with the logarithm of the longest path; each round is a written table, so a lost executor costs one round.
    Self-links, repeated links and nulls do not matter.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = now, edges
        edges = materialize(_stars(_stars(edges, False), True), "edges")
        discard(old)
