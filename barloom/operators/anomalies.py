"""Outlier and anomaly flags on (symbol, date) series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import frame_values, interpolated, roll, series


def _flag(cond):
    return F.coalesce(cond, F.lit(False)).cast("int")


def zscore(df: DataFrame, col: str = "close", threshold: float = 3.0, n: int | None = 20, out: str = "is_anomaly") -> DataFrame:
    """|x - mean| / std above the threshold; over the last n rows, or over the whole series when n is None."""
    if n is None:
        w = W.partitionBy("symbol")
        mean, sd = F.avg(col).over(w), F.stddev_samp(col).over(w)
    else:
        mean, sd = roll(F.avg, col, n), roll(F.stddev_samp, col, n)
    return df.withColumn(out, _flag(F.abs(F.try_divide(F.col(col) - mean, sd)) > threshold))


def iqr(df: DataFrame, col: str = "close", factor: float = 1.5, n: int | None = 20, out: str = "is_anomaly") -> DataFrame:
    """Outside the quartile fences of the previous n rows, or of the whole series when n is None."""
    if n is None:
        w = W.partitionBy("symbol")
        df = df.withColumns({"_q1": F.percentile(col, 0.25).over(w), "_q3": F.percentile(col, 0.75).over(w), "_full": F.lit(True)})
    else:
        df = df.withColumn("_f", frame_values(col, n, end=-1))
        df = df.withColumns({"_q1": interpolated(F.col("_f"), 0.25), "_q3": interpolated(F.col("_f"), 0.75),
                             "_full": F.size("_f") == n}).drop("_f")
    span = F.col("_q3") - F.col("_q1")
    hit = (F.col(col) < F.col("_q1") - factor * span) | (F.col(col) > F.col("_q3") + factor * span)
    return df.withColumn(out, _flag(F.col("_full") & hit)).drop("_q1", "_q3", "_full")


def moving_average(df: DataFrame, col: str = "close", threshold: float = 3.0, n: int = 20, out: str = "is_anomaly") -> DataFrame:
    mean, sd = roll(F.avg, col, n), roll(F.stddev_samp, col, n)
    return df.withColumn(out, _flag((F.col(col) > mean + threshold * sd) | (F.col(col) < mean - threshold * sd)))


def lof(df: DataFrame, col: str = "close", k: int = 20, contamination: float = 0.05, out: str = "is_anomaly") -> DataFrame:
    """Local outlier factor of each value inside its series.

    The k nearest values on a line lie among the k next lower and k next higher ones, so the neighbours come
    from a frame of 2k+1 rows ordered by value: no self-join and no pairs beyond the frame.  The row numbers bring each
    series into one partition, in the order of its values; a step is one array operation for many whole series.
    """
    schema = T.StructType([f for f in df.schema if f.name not in ("lof", out)] + [T.StructField("lof", T.DoubleType()), T.StructField(out, T.IntegerType())])
    kept = schema.names[:-2]

    def run(batches):
        held, size, last = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("_row").to_numpy(zero_copy_only=False)
            if not ((rows == 1) | (rows == np.concatenate(([last], rows[:-1])) + 1)).all():
                raise RuntimeError("the rows of a series do not follow each other")
            last = rows[-1]
            starts = np.flatnonzero(rows == 1)
            if size >= ROWS and len(starts):
                yield from scored([*held, batch.slice(0, starts[-1])])
                batch, held, size = batch.slice(starts[-1]), [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from scored(held)

    def scored(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        if not table.num_rows:
            return
        v, rank = table["_v"].combine_chunks(), pc.rank(table["date"], tiebreaker="dense").to_numpy().astype("int64")
        date = np.where(table["date"].is_valid().to_numpy(), rank, 0)
        factor, known, flag = _factors(v.fill_null(0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False), date,
                                       np.flatnonzero(table["_row"].to_numpy() == 1), k, 1 - contamination)
        result = table.select(kept).append_column("lof", pa.array(factor, mask=~known, from_pandas=False)).append_column(out, pa.array(flag.astype("int32")))
        yield from result.to_batches(max_chunksize=ROWS)

    order = W.partitionBy("symbol").orderBy(col, "date")
    rows = df.select("*", F.row_number().over(order).alias("_row"), F.col(col).cast("double").alias("_v"))
    return rows.mapInArrow(run, schema).select(*df.columns, *[c for c in ("lof", out) if c not in df.columns])


#: Rows of whole series that are worked on at once, rows whose frames are laid out at once.
ROWS, FRAMES = 1 << 15, 1 << 12


def _factors(v, null, date, starts, k, q):
    """Factors, which of them are known and whether they lie above the quantile q of their series, for values in order.

    ``null`` marks missing values, a ``date`` of 0 is a missing one, a series begins at each of ``starts``.  A missing distance
    counts as the least, as in the order of rows.
    """
    n = len(v)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    begins = np.repeat(starts, np.diff(np.append(starts, n)))
    near, size, again = np.zeros((n, k), dtype="int32"), np.zeros(n, dtype="int64"), []
    steps = np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])

    def frames(at):
        own = at[:, None]
        other = own + steps
        inside = (other >= begins[own]) & (other < ends[own])
        other = np.where(inside, other, own)
        ok = inside & (date[other] != date[own]) & (date[other] > 0) & (date[own] > 0)
        with np.errstate(invalid="ignore"):
            return other, ok, np.abs(v[other] - v[own]), null[other] | null[own]

    def exact(at, x=None, unknown=None):
        """The k nearest by distance, date and x; and which rows have places that only x tells apart."""
        other, ok, d, missing = frames(at)
        kind, d = np.where(ok, np.where(missing, 0, 1), 2), np.where(missing, 0.0, d)
        keys = [date[other], d, kind]
        if x is not None:
            keys = [x[other], ~unknown[other], *keys]
        order = np.lexsort(keys, axis=-1)[:, :k + 1]
        near[at, :] = np.take_along_axis(other, order[:, :k], 1)
        same = np.take_along_axis(ok, order, 1)[:, 1:]
        for key in (date[other], d, kind):
            key = np.take_along_axis(key, order, 1)
            same &= (key[:, 1:] == key[:, :-1]) | ((key[:, 1:] != key[:, 1:]) & (key[:, :-1] != key[:, :-1]))
        return at[same.any(1)]

    for s in range(0, n, FRAMES):
        at = np.arange(s, min(s + FRAMES, n))
        other, ok, d, missing = frames(at)
        size[at] = np.minimum(ok.sum(1), k)
        far = np.where(ok, d, np.inf)
        order = np.argsort(far, axis=1)[:, :k + 1]
        near[at, :] = np.take_along_axis(other, order[:, :k], 1)
        d = np.take_along_axis(far, order, 1)
        odd = ((d[:, 1:] == d[:, :-1]) & (d[:, 1:] < np.inf)).any(1) | (ok & (missing | ~(far < np.inf))).any(1)
        if odd.any():
            again.append(exact(at[odd]))
    again = np.concatenate(again) if again else np.zeros(0, dtype="int64")

    def mean(term):
        """Means over the neighbours, added from the nearest on, of values and whether they are missing."""
        total, unknown = np.zeros(n), size == 0
        for j in range(k):
            here = size > j
            x, lost = term(near[:, j])
            total += np.where(here, x, 0.0)
            unknown |= here & lost
        with np.errstate(all="ignore"):
            return total / size, unknown

    def distance(j):
        with np.errstate(invalid="ignore"):
            return np.abs(v[j] - v), null[j] | null

    with np.errstate(all="ignore"):
        kd, kd_null = np.zeros(n), np.ones(n, dtype=bool)
        for j in range(k):
            d, lost = distance(near[:, j])
            lost |= size <= j
            kd, kd_null = np.where(lost, kd, np.maximum(kd, d)), kd_null & lost

        def reach(j):
            d, lost = distance(j)
            return np.where(lost, kd[j], np.where(kd_null[j], d, np.maximum(kd[j], d))), lost & kd_null[j]

        if len(again):
            exact(again, kd, kd_null)
        m, lost = mean(reach)
        lrd = 1 / (m + 1e-10)
        if len(again):
            exact(again, lrd, lost)
        m, unknown = mean(lambda j: (lrd[j], lost[j]))
        unknown |= lost | (lrd == 0)
        factor = m / lrd
    cut = _quantiles(factor, ~unknown, starts, q)[np.searchsorted(starts, np.arange(n), "right") - 1]
    return factor, ~unknown, ~unknown & ((factor > cut) | (np.isnan(factor) & ~np.isnan(cut)))


def _quantiles(x, known, starts, q):
    """Interpolated quantile of the known values of each series, from the values next to it as Spark's percentile takes them."""
    owner = np.searchsorted(starts, np.flatnonzero(known), "right") - 1
    x = x[known]
    x, count = x[np.lexsort((x, owner))], np.bincount(owner, minlength=len(starts))
    first, at = np.cumsum(count) - count, (count - 1) * q
    low, high = np.floor(at), np.ceil(at)
    some = count > 0
    out, a, b = np.full(len(starts), np.nan), x[(first + low)[some].astype("int64")], x[(first + high)[some].astype("int64")]
    with np.errstate(all="ignore"):
        out[some] = np.where(a == b, a, np.where(high[some] == low[some], a, (high - at)[some] * a + (at - low)[some] * b))
    return out


METHODS = {"zscore": zscore, "iqr": iqr, "moving_average": moving_average, "lof": lof}


def outlier_values(df: DataFrame, col: str = "close", method: str = "zscore", **kwargs) -> DataFrame:
    """Flag by the named method and keep the flagged value in its own column."""
    if method not in METHODS:
        raise ValueError(f"unknown anomaly detection method: {method}")
    df = METHODS[method](df, col, out="is_outlier", **kwargs)
    return df.withColumn("outlier_value", F.when(F.col("is_outlier") == 1, F.col(col)))
