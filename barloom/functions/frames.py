"""Window frames over (symbol, date) series.

A series holds one row per symbol and day, so a window partition is bounded by the calendar.  All frames
share one partitioning and one order, so a stack of indicators costs one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "symbol"
TIME = "date"


def series(key: str | list[str] = KEY, time: str = TIME):
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(time)


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(agg, x, n: int, w=None) -> Column:
    """``agg(x)`` over the last n rows, null until the frame holds n values.

    The values in the frame are the difference of two running counts, which cost one step per row whatever n is.
    """
    if n <= 0:
        raise ValueError("period must be a positive integer")
    w = w or series()
    f = w.rowsBetween(-(n - 1), 0)
    x = as_col(x)
    filled = F.count(x).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.count(x).over(w.rowsBetween(W.unboundedPreceding, -n))
    return F.when(filled >= n, agg(x).over(f))


def prev(x, k: int = 1, w=None) -> Column:
    return F.lag(as_col(x), k).over(w or series())


def rate(x, k: int = 1, w=None) -> Column:
    """x over its value k rows ago, minus one."""
    return F.try_divide(as_col(x), prev(x, k, w)) - 1


def running(agg, x, w=None) -> Column:
    return agg(as_col(x)).over((w or series()).rowsBetween(W.unboundedPreceding, 0))


def running_product(x, w=None) -> Column:
    """Running product of positive-or-negative factors through logs, sign and zero kept apart."""
    x = as_col(x)
    logs = running(F.sum, F.when(x != 0, F.ln(F.abs(x))), w)
    flips = running(F.sum, (x < 0).cast("int"), w)
    zeros = running(F.sum, (x == 0).cast("int"), w)
    return F.when(zeros > 0, F.lit(0.0)).otherwise(F.exp(logs) * F.when(flips % 2 == 1, -1.0).otherwise(1.0))


def product(x) -> Column:
    """Aggregate product of factors, the groupBy form of ``running_product``."""
    x = as_col(x)
    sign = F.when(F.sum((x < 0).cast("int")) % 2 == 1, -1.0).otherwise(1.0)
    logs = F.coalesce(F.sum(F.when(x != 0, F.ln(F.abs(x)))), F.lit(0.0))
    return F.when(F.sum((x == 0).cast("int")) > 0, F.lit(0.0)).otherwise(F.exp(logs) * sign)


def interpolated(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array without nulls."""
    pos = (F.size(sorted_values) - 1) * F.lit(float(q))
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a = F.get(sorted_values, lo)
    b = F.get(sorted_values, hi)
    return a + (b - a) * (pos - lo)


def frame_values(x, n: int, end: int = 0, w=None) -> Column:
    """Sorted values of the n rows that end ``end`` rows from here; at most n elements."""
    f = (w or series()).rowsBetween(end - n + 1, end)
    return F.array_sort(F.collect_list(as_col(x)).over(f))


def ewm_many(df: DataFrame, specs: list[tuple[str, int, str]], key: str = KEY, time: str = TIME) -> DataFrame:
    """Exponential means y = a*y' + (1-a)*x, y1 = x1, a = 1 - 2/(span+1), for (column, span, name) specs.

    A null is no step: it neither decays nor changes the mean, and its row has the mean so far (null before the first value).
    All means share the passes of the slowest one and the order of the series.
    """
    if any(span <= 0 for _, span, _ in specs):
        raise ValueError("span must be a positive integer")
    for x, span, out in specs:
        if span == 1:
            df = df.withColumn(out, F.col(x))
    slow = [s for s in specs if s[1] > 1]
    return _affine(df, [(F.col(x), _keep(n), 1 - _keep(n), out, x) for x, n, out in slow], key, time, seed_first=True) if slow else df


def _keep(span: int) -> float:
    return 1 - 2.0 / (span + 1)


def ewm(df: DataFrame, x: str, span: int, out: str, key: str = KEY, time: str = TIME) -> DataFrame:
    return ewm_many(df, [(x, span, out)], key, time)


def decayed_sums(df: DataFrame, xs: list[tuple[Column, str]], decay: float, key: str = KEY, time: str = TIME, on: str | None = None) -> DataFrame:
    """s = decay*s' + x, from zero, for (expression, name) pairs; rows in which ``on`` is null are no step."""
    return _affine(df, [(x, decay, 1.0, out, on) for x, out in xs], key, time, seed_first=False)


#: Steps that one pass of ``_affine`` adds up.
FAN = 4


def _affine(df, terms, key, time, seed_first):
    """s = a*s' + gain*x for (x, a, gain, name, on) terms; ``on`` is the column whose values are counted as steps, without it
    every row is one.

    Sums of the last 4 steps are made of single steps, those of the last 16 of sums of 4 that lie 4 steps apart, and so on
    until a step that is left out has a weight below 1e-18, which no double can see.  A pass is a lag along the series, so
    all passes keep its order and none sorts the rows again.
    """
    w = series(key, time)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    counted = {on: f"_i{i}" for i, on in enumerate(dict.fromkeys(on for *_, on in terms))}
    df = df.withColumns({name: F.row_number().over(w) if on is None else F.count(on).over(upto) for on, name in counted.items()})
    start = {}
    for j, (x, _, gain, _, on) in enumerate(terms):
        b = F.when(F.col(counted[on]) == 1, x).otherwise(x * gain) if seed_first else x * gain
        start[f"_s{j}"] = F.coalesce(b, F.lit(0.0)) if on is None else F.when(F.col(on).isNotNull(), F.coalesce(b, F.lit(0.0)))
        start[f"_n{j}"] = F.lit(True) if seed_first else F.count(x).over(upto) > 0
    df = df.withColumns(start)
    # 1e-18 is e^-42
    need, width = [math.ceil(42 / -math.log(a)) for _, a, *_ in terms], 1
    while width < max(need):
        wider = {}
        for j, (_, a, _, _, on) in enumerate(terms):
            kind = "" if on is None else "IGNORE NULLS"
            back = [(i * width, F.expr(f"lag(_s{j}, {i * width}) {kind}").over(w)) for i in range(1, FAN) if i * width < need[j]]
            if back:
                wider[f"_s{j}"] = F.when(F.col(f"_s{j}").isNotNull(), sum((F.coalesce(s, F.lit(0.0)) * a**k for k, s in back), F.col(f"_s{j}")))
        df, width = df.withColumns(wider), width * FAN
    full = {out: F.when(F.col(f"_n{j}"), F.col(f"_s{j}") if on is None else F.last(f"_s{j}", ignorenulls=True).over(upto))
            for j, (*_, out, on) in enumerate(terms)}
    return df.withColumns(full).drop(*counted.values(), *[f"_{c}{j}" for j in range(len(terms)) for c in "sn"])
