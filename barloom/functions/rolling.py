"""Mean, deviation, least and greatest value of the last n rows of a series, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import series

#: Column types whose frames are worked on as arrays.
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
NAMES = ("mean", "std", "min", "max")


def _frames(x: np.ndarray, n: int, size: int) -> dict[str, np.ndarray]:
    """The four values of the frames that end at the last ``size`` places of x, added from the oldest row to the newest."""
    first = len(x) - size - n + 1
    total, mean, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    low = high = x[first:first + size]
    for j in range(n):
        v = x[first + j:first + j + size]
        low, high = np.fmin(low, v), np.maximum(high, v)
        total += v
        delta = v - mean
        step = delta / (j + 1)
        mean += step
        m2 += delta * (delta - step)
    return {"mean": total / n, "std": np.sqrt(m2 / n), "min": low, "max": high}


def rolling_batches(df: DataFrame, cols, windows) -> DataFrame:
    """``{column}_{mean|std|min|max}_{n}`` of number columns, null until the frame holds n values; std is the population form.

    The row numbers bring each series into one partition, in its order, so a frame is a run of rows. A batch takes the rows
    before it that its frames reach, whatever the length of a series, and a step is one array operation for all its series.
    """
    if any(n <= 0 for n in windows):
        raise ValueError("period must be a positive integer")
    values = [f"_x{i}" for i in range(len(cols))]
    out = {}
    for c, x in zip(cols, df.select(*cols).schema):
        for n in windows:
            out |= {f"{c}_{k}_{n}": T.StructField(f"{c}_{k}_{n}", x.dataType if k in ("min", "max") else T.DoubleType()) for k in NAMES}
    kept = [c for c in df.columns if c not in out]
    schema = T.StructType([f for f in df.schema if f.name not in out] + list(out.values()))
    back = max(windows) - 1

    def run(batches):
        last, xs, oks = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("_row").to_numpy(zero_copy_only=False)
            before = np.concatenate(([last], rows[:-1]))
            if not ((rows == 1) | (rows == before + 1)).all():
                raise RuntimeError("the rows of a series do not follow each other")
            last, size = rows[-1], len(rows)
            new = [batch.column(v) for v in values]
            now = [v.fill_null(0).to_numpy(zero_copy_only=False) for v in new]
            if xs is None:
                xs, oks = [np.zeros(back, v.dtype) for v in now], [np.zeros(back, bool) for _ in now]
            arrays = {c: batch.column(c) for c in kept}
            for i, c in enumerate(cols):
                x = np.concatenate((xs[i], now[i]))
                ok = np.concatenate((oks[i], new[i].is_valid().to_numpy(zero_copy_only=False)))
                filled = np.concatenate(([0], np.cumsum(ok)))
                for n in windows:
                    whole = (rows >= n) & (filled[back + 1:] - filled[back + 1 - n:back + 1 - n + size] == n)
                    with np.errstate(all="ignore"):
                        got = _frames(x, n, size)
                    for k, v in got.items():
                        arrays[f"{c}_{k}_{n}"] = pa.array(v, mask=~whole, from_pandas=False)
                xs[i], oks[i] = x[size:], ok[size:]
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], names=schema.names)

    rows = df.withColumns({"_row": F.row_number().over(series())} | {v: F.col(c) for v, c in zip(values, cols)})
    order = [*df.columns, *[c for c in out if c not in df.columns]]
    return rows.select(*kept, "_row", *values).mapInArrow(run, schema).select(*order)
