"""Exact global quantiles and row numbers without a global window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Evenly spaced edges of a later round; values of a bracket that are ranked as they are.
GRID, LEAF = 64, 1 << 16


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int = 10_000, leaf: int = LEAF) -> DataFrame:
    """(name, q, value): exact interpolated quantiles of whole columns; nulls and NaN are left out, an empty column has no row.

    Selection by rounds.  A round takes edges from a mergeable sketch, counts the values at and between the edges, and keeps
    for every wanted rank the bin that holds it.  Edges are values of the data and bins of their own, so a value that fills
    the column ends the search, every round leaves fewer values, and an inexact sketch costs a round and never a result.
    The first round's edges lie close to the quantiles, those of later rounds are a grid.  A bin of at most ``leaf`` values
    is ranked as it is.  What reaches the driver are counts: per column and quantile one row per bin.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(cells.alias("x")).select("x.name", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    near = 2.0 / accuracy
    marks = sorted({min(max(q + d, 0.0), 1.0) for q in qs for d in (-near, near)})
    whole = long.groupBy("name").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", marks, accuracy).alias("edges")).collect()  # a row per column
    size = {r["name"]: r["n"] for r in whole}
    # wanted ranks (from 0) and the bin that holds each: (name, lo, hi, values below, values inside)
    wanted = {(name, rank): None for name, n in size.items() for q in qs for rank in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}
    bins = {r["name"]: (r["name"], r["lo"], r["hi"], 0, r["n"]) for r in whole}
    wanted = {key: bins[key[0]] for key in wanted}
    edges = {bins[r["name"]]: r["edges"] for r in whole}
    found: dict[tuple[str, int], float] = {}
    while wanted:
        found |= {key: b[1] for key, b in wanted.items() if b[1] == b[2]}
        wanted = {key: b for key, b in wanted.items() if b[1] != b[2]}
        large = sorted({b for b in wanted.values() if b[4] > leaf})
        if not large:
            break
        if not all(b in edges for b in large):
            grid = [i / GRID for i in range(GRID + 1)]
            rows = _inside(long, large).groupBy("at").agg(F.percentile_approx("v", grid, accuracy).alias("edges")).collect()  # a row per bin
            edges = {large[r["at"]]: r["edges"] for r in rows}
        rows = _inside(long, large, [edges[b] for b in large])
        counted = rows.groupBy("at", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at", "bin").collect()  # a row per bin
        for at, old in enumerate(large):
            below = old[3]
            for r in (r for r in counted if r["at"] == at):
                new = (old[0], r["lo"], r["hi"], below, r["n"])
                wanted |= {(name, rank): new for (name, rank), b in wanted.items() if b == old and below <= rank < below + r["n"]}
                below += r["n"]
        edges = {}
    if wanted:
        small = sorted(set(wanted.values()))
        counts = _inside(long, small).groupBy("at", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy("at").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        ranks = long.sparkSession.createDataFrame([(small.index(b), rank - b[3], name, rank) for (name, rank), b in wanted.items()], "at int, place long, name string, rank long")
        hit = counts.withColumn("upto", upto).join(F.broadcast(ranks), "at").where("upto > place AND upto - c <= place")
        found |= {(r["name"], r["rank"]): r["v"] for r in hit.select("name", "rank", "v").collect()}  # a row per rank
    out = []
    for name, n in size.items():
        for q in qs:
            pos = (n - 1) * q
            lo, hi = found[name, math.floor(pos)], found[name, math.ceil(pos)]
            out.append((name, float(q), lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))))
    return long.sparkSession.createDataFrame(out, "name string, q double, value double")


def _inside(long: DataFrame, bins: list[tuple], edges: list[list[float]] | None = None) -> DataFrame:
    """at, v of the values in each bin (its place in the list), with ``bin``, the place among its edges, if those are given."""
    most = max(map(len, edges)) if edges else 0
    rows = [(at, b[0], b[1], b[2], *([*edges[at], *[b[2]] * (most - len(edges[at]))] if edges else [])) for at, b in enumerate(bins)]
    names = [f"e{i}" for i in range(most)]
    table = long.sparkSession.createDataFrame(rows, ", ".join(["at int, name string, lo double, hi double", *[f"{e} double" for e in names]]))
    found = long.join(F.broadcast(table), "name").where("v >= lo AND v <= hi")  # bins x edges numbers
    place = [F.expr(" + ".join(f"int(v >= {e}) + int(v > {e})" for e in names)).alias("bin")] if names else []
    return found.select("at", "v", *place)


def quantile_map(df: DataFrame, cols: list[str], qs: list[float]) -> Column:
    """The quantiles as one small map under keys like 'close@0.25', as a scalar subquery."""
    q = exact_quantiles(df, cols, qs)
    key = F.concat("name", F.lit("@"), F.col("q").cast("string"))
    return q.agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "value")))).scalar()


#: Rows of a range that one task numbers.
RANGE = 1 << 20


def with_row_index(df: DataFrame, first: str, rest: list[str], out: str = "row_index", size: int = RANGE) -> DataFrame:
    """Zero-based position of every row in the order (first, *rest).

    Spark's range partitioning over all keys deals the rows into ranges of about ``size`` rows, so a value of ``first``
    with a third of the rows is split by the keys behind it.  The ranges are written once, each counts its rows, the
    running total of the counts (one row per range) is its offset, and rows are numbered inside their range.  Equal rows
    have neighbouring numbers in any order; nulls come first.
    """
    from barloom.sources.readers import materialize

    keys = [first, *rest]
    n = df.count()
    dealt = materialize(df.repartitionByRange(max(1, -(-n // size)), *keys).withColumn("_r", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_r", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy("_r").orderBy(*keys)) - 1
    return dealt.join(offsets, "_r").withColumn(out, F.col("_o") + inside).drop("_r", "_o")
