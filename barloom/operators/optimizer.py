"""Long-only portfolios of least variance for given appetites for return, all of them at once.

Per appetite a the weights minimise variance / 2 - a * mean over weights that are not negative and add up to one.  With
missing returns as zero, the covariance of every asset with a portfolio is one pass over the returns, so a step of the
search needs no covariance matrix: accelerated projected gradients, each asset's step scaled by its own variance, a step
that makes things worse is taken back and shortened.  The series are stored once; a step stores weights alone, in the same
buckets, and meets the series without a shuffle.  What passes through the driver is a series per appetite (dates x
appetites numbers) and never a number per asset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.readers import bucketed, discard, materialize

#: Points of the frontier, steps of the search, places at which a threshold is tried in one pass, and such passes.
POINTS, ROUNDS, GRID, PASSES = 50, 24, 512, 2
YEAR = 252
#: Assets of a bucket, where there are more than a few for each core.
BUCKET = 4096


def series(returns: DataFrame) -> tuple[DataFrame, int, int]:
    """Per asset its returns that are not null (day numbers and values, packed), mean and variance over all days; the number
    of days and of buckets.  A row is bounded by the calendar.  Assets without any variance are left out."""
    dated, ret = F.col("date").isNotNull(), F.col("ret").cast("double")
    found = materialize(returns.where("ret is not null").groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(dated, F.struct(F.unix_date("date").alias("day"), ret.alias("ret"))))).alias("s"),
        F.sum(F.when(dated, F.col("ret"))).alias("total"), F.sum(F.when(dated, F.col("ret") * F.col("ret"))).alias("squares"),
        F.bool_or(~dated).alias("undated")), "symbols")
    days = found.select(F.explode("s.day").alias("day")).distinct().orderBy("day").toPandas()["day"].to_numpy(np.int32)  # one row per trading day
    head = found.agg(F.count("*").alias("n"), F.bool_or("undated").alias("undated")).first()
    n_days = len(days) + bool(head.undated)  # returns without a date count as one more day
    n = max(n_days, 2)
    variance = (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1)
    key = F.coalesce(F.concat(F.lit("="), F.col("symbol").cast("string")), F.lit(""))
    rows = found.select(key.alias("key"), "symbol", F.col("s.day").alias("days"), F.col("s.ret").alias("rets"), (F.col("total") / n).alias("mean"), variance.alias("variance")).where("variance > 1e-300")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column("days").value_lengths().to_numpy()))
            numbers = np.searchsorted(days, batch.column("days").flatten().to_numpy()).astype(np.int32)
            values = batch.column("rets").flatten().to_numpy()
            yield batch.set_column(2, "days", packed(numbers, ends)).set_column(3, "rets", packed(values, ends))

    kind = rows.schema["symbol"].dataType.simpleString()
    rows = rows.mapInArrow(pack, f"key string, symbol {kind}, days binary, rets binary, mean double, variance double")
    buckets = max(min(2 * returns.sparkSession.sparkContext.defaultParallelism, -(-head.n // 64)), -(-head.n // BUCKET), 1)
    stored = bucketed(rows.repartition(buckets, "key"), "key", buckets, "series")
    discard(found)
    return stored, n_days, buckets


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers as a column of bytes; run i has the values from ``ends[i]`` to ``ends[i + 1]``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of ``packed`` and how many each row has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, (at[-1] - at[0]) // size, at[0]), np.diff(at) // size


def dense(batch: pa.RecordBatch, n_days: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their returns as a matrix of bounded size."""
    size = max(1, (1 << 20) // max(n_days, 1))
    for at in range(0, len(batch), size):
        part = batch.slice(at, size)
        (days, lengths), (rets, _) = unpacked(part.column("days"), np.int32), unpacked(part.column("rets"), float)
        x = np.zeros((len(part), n_days))
        x[np.repeat(np.arange(len(part)), lengths), days] = rets
        yield part, x


def floats(column: pa.Array, width: int) -> np.ndarray:
    return unpacked(column, float)[0].reshape(-1, width)


def rows_of(values: np.ndarray) -> pa.Array:
    """A row of a matrix per row, as ``floats`` reads it."""
    return packed(values.ravel(), np.arange(len(values) + 1) * values.shape[1])


def total(rows: DataFrame, fn, size: int) -> np.ndarray:
    """The sum of ``fn(batch)``, ``size`` numbers, over all batches: a row per task and block of numbers, added up in Spark."""
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            if len(batch):
                acc += fn(batch)
        parts = [acc[i:i + block].tobytes() for i in range(0, size, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        acc = sum(np.frombuffer(x.as_py(), float) for x in table["sums"])
        return pa.table([table["block"][:1], pa.array([acc.tobytes()], pa.binary())], names=["block", "sums"])

    found = rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums, float) for r in sorted(found, key=lambda r: r.block)]) if found else np.zeros(size)


class Search:
    """State of the search; all arrays have a column per appetite."""

    def __init__(self, returns: DataFrame, points: int = POINTS, rounds: int = ROUNDS):
        self.rows, self.n_days, self.buckets = series(returns)
        self.points, self.rounds = points, rounds

    def met(self, table: DataFrame) -> DataFrame:
        """The series of the assets beside their weights, bucket by bucket."""
        return self.rows.select("key", "days", "rets", "mean").join(table.hint("shuffle_hash"), "key")

    def store(self, weights: DataFrame) -> DataFrame:
        return bucketed(weights, "key", self.buckets, "step")

    def aggregates(self):
        inverse = F.sum(1 / F.col("variance"))
        return self.rows.agg(F.count("*").alias("n"), inverse.alias("inverse"), F.min("mean").alias("low"), F.max("mean").alias("high")).first()

    def combined(self, table: DataFrame, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centred series (days x appetites), mean and sum of the weights that a threshold gives."""
        n_days, k = self.n_days, self.points

        def fn(batch: pa.RecordBatch) -> np.ndarray:
            acc = np.zeros((n_days + 2, k))
            for part, x in dense(batch, n_days):
                w = np.maximum(0, floats(part.column("u"), k) - threshold / part.column("variance").to_numpy()[:, None])
                acc[:n_days] += x.T @ w
                acc[n_days] += part.column("mean").to_numpy() @ w
                acc[n_days + 1] += w.sum(0)
            return acc.ravel()

        found = total(self.met(table.select("key", "variance", "u")), fn, (n_days + 2) * k).reshape(-1, k)
        return found[:n_days] - found[n_days], found[n_days], found[n_days + 1]

    def thresholds(self, table: DataFrame) -> np.ndarray:
        """The threshold t with sum(max(0, u - t / variance)) = 1 per appetite, narrowed on a grid and interpolated."""
        k = self.points

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u_sum, inverse, top = np.zeros(k), 0.0, np.full(k, -np.inf)
            for batch in batches:
                if len(batch):
                    u, v = floats(batch.column("u"), k), batch.column("variance").to_numpy()[:, None]
                    u_sum, inverse, top = u_sum + u.sum(0), inverse + (1 / v).sum(), np.maximum(top, (u * v).max(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(u_sum), pa.array(np.full(k, inverse)), pa.array(top)], ["point", "u", "inverse", "top"])

        spans = table.select("variance", "u").mapInArrow(ends, "point bigint, u double, inverse double, top double")
        spans = spans.groupBy("point").agg(F.sum("u").alias("u"), F.sum("inverse").alias("inverse"), F.max("top").alias("top")).orderBy("point").collect()
        u_sum, inverse, high = (np.array([r[c] for r in spans]) for c in ("u", "inverse", "top"))
        low = np.minimum((u_sum - 1) / inverse, high)  # the sum is convex in t, so its steepest line gives a bound
        for _ in range(PASSES):
            grid = low + (high - low) * np.linspace(0, 1, GRID)[:, None]

            def fn(batch: pa.RecordBatch, grid=grid, low=low, high=high) -> np.ndarray:
                # an asset counts at the places below u * variance: sums per number of such places, added from behind
                u, v = floats(batch.column("u"), k), batch.column("variance").to_numpy()[:, None]
                wide = np.where(high > low, high - low, 1)
                places = np.where(high > low, np.ceil((u * v - low) / wide * (GRID - 1)), np.where(u * v > low, GRID, 0))
                cells = (np.clip(places, 0, GRID).astype(np.int64) * k + np.arange(k)).ravel()
                sums = [np.bincount(cells, x.ravel(), (GRID + 1) * k).reshape(-1, k)[::-1].cumsum(0)[::-1][1:] for x in (u, np.broadcast_to(1 / v, u.shape))]
                return (sums[0] - grid * sums[1]).ravel()

            sums = total(table.select("variance", "u"), fn, GRID * k).reshape(GRID, k)
            at = np.clip((sums >= 1).sum(0) - 1, 0, GRID - 2)
            one = np.arange(k)
            low, high, a, b = grid[at, one], grid[at + 1, one], sums[at, one], sums[at + 1, one]
        share = np.divide(a - 1, a - b, out=np.zeros(k), where=a > b)
        return low + (high - low) * np.clip(share, 0, 1)

    def step(self, table: DataFrame, threshold: np.ndarray, taken: np.ndarray, push: np.ndarray, at: np.ndarray, size: np.ndarray, appetite: np.ndarray) -> DataFrame:
        """Weights after the last step (old ones where it was taken back) and where the next one would lead without bounds."""
        n_days, k = self.n_days, self.points
        names = ["key", "symbol", "variance", "u", "w"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, x in dense(batch, n_days):
                    v, old = part.column("variance").to_numpy()[:, None], floats(part.column("w"), k)
                    w = np.where(taken, np.maximum(0, floats(part.column("u"), k) - threshold / v), old)
                    slope = x @ at / (n_days - 1) - appetite * part.column("mean").to_numpy()[:, None]
                    u = w + push * (w - old) - slope / (size * v)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:3]], rows_of(u), rows_of(w)], names)

        return self.store(self.met(table).mapInArrow(run, table.schema))

    def solve(self) -> pd.DataFrame:
        """appetite, expected_return, volatility and gap per point, and the series of each in ``self.curves``.

        gap bounds how far the objective is from its least value, as a share of the variance; both are a year's figures.
        """
        head, k = self.aggregates(), self.points
        if not head.n:
            self.curves, self.weights = np.zeros((0, k)), None
            return pd.DataFrame({"point": [], "appetite": [], "expected_return": [], "volatility": [], "gap": []})
        start = self.rows.select("key", "symbol", "variance", F.lit(None).cast("binary").alias("u"), F.lit(None).cast("binary").alias("w"))
        inverse = head.inverse

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = rows_of(np.repeat(1 / batch.column("variance").to_numpy()[:, None] / inverse, k, 1))
                yield batch.set_column(3, "u", w).set_column(4, "w", w)

        table = self.store(start.mapInArrow(begin, start.schema))
        none = np.zeros(k)
        curve, mean, _ = self.combined(table, none)
        variance = (curve * curve).sum(0) / max(self.n_days - 1, 1)
        i = np.arange(k)
        unit = variance[0] / max(head.high - head.low, 1e-300)
        appetite = unit * np.where(i < k - 1, i / np.maximum(k - 1 - i, 1), 2 * k) ** 2.0
        loss = variance / 2 - appetite * mean
        size, clock, threshold = np.full(k, 1.5), np.ones(k), none
        before, at, push, taken = curve, curve, none, np.ones(k, bool)
        for _ in range(self.rounds):
            old = table
            table = self.step(table, threshold, taken, push, at, size, appetite)
            discard(old)
            threshold = self.thresholds(table)
            new, new_mean, _ = self.combined(table, threshold)
            new_variance = (new * new).sum(0) / (self.n_days - 1)
            new_loss = new_variance / 2 - appetite * new_mean
            taken = new_loss <= loss + 1e-15 * np.abs(loss)
            # a step too long shows as a loss; one taken back is tried again shorter and without momentum
            momentum = push > 0
            size = np.where(taken | momentum, size, size * 1.5)
            before, curve = np.where(taken, curve, before), np.where(taken, new, curve)
            mean, variance, loss = np.where(taken, new_mean, mean), np.where(taken, new_variance, variance), np.where(taken, new_loss, loss)
            later = (1 + np.sqrt(1 + 4 * clock * clock)) / 2
            push = np.where(taken, (clock - 1) / later, 0.0)
            clock = np.where(taken, later, 1.0)
            at = curve + push * (curve - before)
        self.table, self.threshold, self.taken, self.curves = table, threshold, taken, curve
        gap = self.gaps(appetite)
        return pd.DataFrame({"point": i, "appetite": appetite, "expected_return": mean * YEAR, "volatility": np.sqrt(variance * YEAR), "gap": gap / np.maximum(variance, 1e-300)})

    def gaps(self, appetite: np.ndarray) -> np.ndarray:
        """Slope of the objective along the weights, less the least slope of any asset."""
        n_days, k, curves, threshold, taken = self.n_days, self.points, self.curves, self.threshold, self.taken

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, least, weight = np.zeros(k), np.full(k, np.inf), np.zeros(k)
            for batch in batches:
                for part, x in dense(batch, n_days):
                    v = part.column("variance").to_numpy()[:, None]
                    w = np.where(taken, np.maximum(0, floats(part.column("u"), k) - threshold / v), floats(part.column("w"), k))
                    slope = x @ curves / (n_days - 1) - appetite * part.column("mean").to_numpy()[:, None]
                    own, weight, least = own + (w * slope).sum(0), weight + w.sum(0), np.minimum(least, slope.min(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(own), pa.array(weight), pa.array(least)], ["point", "own", "weight", "least"])

        found = self.met(self.table).mapInArrow(run, "point bigint, own double, weight double, least double").groupBy("point").agg(
            F.sum("own").alias("own"), F.sum("weight").alias("weight"), F.min("least").alias("least"))
        out = np.zeros(k)
        for r in found.collect():
            out[r.point] = max(r.own - r.least * r.weight, 0.0)
        return out

    def weights_of(self, shares: dict[int, float]) -> DataFrame:
        """(symbol, weight) of a mix of points; weights are not negative and add up to one."""
        k, threshold, taken = self.points, self.threshold, self.taken
        mix = np.zeros(k)
        for point, share in shares.items():
            mix[point] = share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                v = part.column("variance").to_numpy()[:, None]
                w = np.where(taken, np.maximum(0, floats(part.column("u"), k) - threshold / v), floats(part.column("w"), k))
                yield pa.RecordBatch.from_arrays([part.column("symbol"), pa.array(w @ mix)], ["symbol", "weight"])

        kind = self.rows.schema["symbol"].dataType.simpleString()
        raw = self.table.select("symbol", "variance", "u", "w").mapInArrow(run, f"symbol {kind}, weight double")
        return raw.select("symbol", (F.col("weight") / raw.agg(F.sum("weight")).scalar()).alias("weight"))


FRONTIER = "point int, expected_return double, volatility double, sharpe_ratio double, gap double"


def ratio(excess: float, volatility: float) -> float | None:
    return float(excess / volatility) if volatility > 0 else None


def efficient_frontier(returns: DataFrame, points: int = POINTS, rounds: int = ROUNDS, rf: float = 0.0) -> DataFrame:
    """``points`` portfolios from the least volatile one to that of the highest mean return."""
    found = Search(returns, points, rounds).solve()
    rows = [(int(r.point), r.expected_return, r.volatility, ratio(r.expected_return - rf, r.volatility), r.gap) for r in found.itertuples()]
    return returns.sparkSession.createDataFrame(rows, FRONTIER)


def weight_search(returns: DataFrame, rf: float = 0.0, target_return: float | None = None, target_volatility: float | None = None,
                  points: int = POINTS, rounds: int = ROUNDS) -> DataFrame:
    """The best portfolio per objective: sharpe, min_volatility, max_return, and where asked for the least volatility with
    ``target_return`` and the highest return within ``target_volatility`` (no row if out of reach).

    Neighbouring points of the frontier are mixed, as a mix of two portfolios is one: low and high are the points, share
    that of the higher.  gap is the greater one of the two.
    """
    search = Search(returns, points, rounds)
    found = search.solve()
    schema = "objective string, low int, high int, share double, expected_return double, volatility double, sharpe_ratio double, gap double"
    if not len(found):
        return returns.sparkSession.createDataFrame([], schema)
    curves, n = search.curves, search.n_days
    mean, gap = found["expected_return"].to_numpy(), found["gap"].to_numpy()
    mixes = []
    for i in range(points - 1):
        for share in np.linspace(0, 1, 33):
            curve = (1 - share) * curves[:, i] + share * curves[:, i + 1]
            mixes.append((i, share, (1 - share) * mean[i] + share * mean[i + 1], math.sqrt(max(curve @ curve, 0.0) / (n - 1) * YEAR)))

    def exact(target: float, column: int):
        """The mix whose return (2) or volatility (3) is the target, between two tried ones."""
        for a, b in zip(mixes, mixes[1:]):
            if a[0] == b[0] and min(a[column], b[column]) <= target <= max(a[column], b[column]):
                low, high = a[1], b[1]
                for _ in range(60):
                    share = (low + high) / 2
                    curve = (1 - share) * curves[:, a[0]] + share * curves[:, a[0] + 1]
                    row = (a[0], share, (1 - share) * mean[a[0]] + share * mean[a[0] + 1], math.sqrt(max(curve @ curve, 0.0) / (n - 1) * YEAR))
                    low, high = (share, high) if (row[column] < target) == (a[column] < b[column]) else (low, share)
                return row
        return None

    best = {"sharpe": max(mixes, key=lambda m: (m[2] - rf) / m[3] if m[3] > 0 else -math.inf), "min_volatility": min(mixes, key=lambda m: m[3]), "max_return": max(mixes, key=lambda m: m[2])}
    if target_return is not None:
        best["target_return"] = best["min_volatility"] if best["min_volatility"][2] >= target_return else exact(target_return, 2)
    if target_volatility is not None:
        best["target_volatility"] = best["max_return"] if best["max_return"][3] <= target_volatility else exact(target_volatility, 3)
    rows = [(k, m[0], m[0] + 1, float(m[1]), float(m[2]), float(m[3]), ratio(m[2] - rf, m[3]), float(max(gap[m[0]], gap[m[0] + 1]))) for k, m in best.items() if m]
    return returns.sparkSession.createDataFrame(rows, schema)
