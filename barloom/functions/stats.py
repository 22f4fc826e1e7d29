"""Aggregate expressions and distribution constants for return statistics."""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import as_col, interpolated

PERIODS = {"daily": 252, "weekly": 52, "monthly": 12, "annual": 1}


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_pdf(x: float) -> float:
    return NormalDist().pdf(x)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio(a, b) -> Column:
    """a / b, or zero where b is zero or null."""
    return zero_if_null(F.try_divide(as_col(a), as_col(b)))


def sharpe(x, rf: float = 0.0, factor: int = 252) -> Column:
    """Mean over std of the excess over rf/factor, annualised; zero without spread."""
    e = as_col(x) - rf / factor
    return ratio(F.avg(e), F.stddev_samp(e)) * math.sqrt(factor)


def sortino(x, rf: float = 0.0, factor: int = 252) -> Column:
    e = as_col(x) - rf / factor
    return ratio(F.avg(e), F.stddev_samp(F.when(e < 0, e))) * math.sqrt(factor)


def sortino_target(x, rf: float = 0.0, factor: int = 252, target: float = 0.0) -> Column:
    """Downside as the root mean square of excess returns below the target; rf is per period."""
    e = as_col(x) - rf
    return ratio(F.avg(e), F.sqrt(F.avg(F.when(e < target, e * e)))) * math.sqrt(factor)


def sample_skew(x) -> Column:
    """Bias-corrected skewness from Spark's population form."""
    n = F.count(as_col(x)).cast("double")
    return F.when(n > 2, F.skewness(as_col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x) -> Column:
    n = F.count(as_col(x)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(as_col(x)) + 6))


def sorted_values(x) -> Column:
    """All values of a calendar-bounded series, sorted, for several quantiles and tails at once."""
    return F.array_sort(F.collect_list(as_col(x)))


def var_of(values: Column, level: float) -> Column:
    return -interpolated(values, 1 - level)


def tail_mean(values: Column, var: Column) -> Column:
    """Loss beyond the given value at risk; the value at risk itself when nothing lies beyond."""
    tail = F.filter(values, lambda v: v <= -var)
    total = F.aggregate(tail, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(-F.try_divide(total, F.size(tail)), var)


def omnibus_expr(n: str, skew: str, kurt: str) -> str:
    """D'Agostino-Pearson K2 from count, population skewness and excess kurtosis; plain SQL text."""
    y = f"({skew} * sqrt(({n} + 1.0) * ({n} + 3.0) / (6.0 * ({n} - 2.0))))"
    b2 = f"(3.0 * ({n} * {n} + 27.0 * {n} - 70.0) * ({n} + 1.0) * ({n} + 3.0) / (({n} - 2.0) * ({n} + 5.0) * ({n} + 7.0) * ({n} + 9.0)))"
    w2 = f"(-1.0 + sqrt(2.0 * ({b2} - 1.0)))"
    u = f"({y} / sqrt(2.0 / ({w2} - 1.0)))"
    zs = f"(1.0 / sqrt(0.5 * ln({w2})) * ln({u} + sqrt({u} * {u} + 1.0)))"
    var = f"(24.0 * {n} * ({n} - 2.0) * ({n} - 3.0) / (({n} + 1.0) * ({n} + 1.0) * ({n} + 3.0) * ({n} + 5.0)))"
    x = f"(({kurt} + 3.0 - 3.0 * ({n} - 1.0) / ({n} + 1.0)) / sqrt({var}))"
    sb = f"(6.0 * ({n} * {n} - 5.0 * {n} + 2.0) / (({n} + 7.0) * ({n} + 9.0)) * sqrt(6.0 * ({n} + 3.0) * ({n} + 5.0) / ({n} * ({n} - 2.0) * ({n} - 3.0))))"
    a = f"(6.0 + 8.0 / {sb} * (2.0 / {sb} + sqrt(1.0 + 4.0 / ({sb} * {sb}))))"
    den = f"(1.0 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    t2 = f"(sign({den}) * power((1.0 - 2.0 / {a}) / abs({den}), 1.0 / 3.0))"
    zk = f"((1.0 - 2.0 / (9.0 * {a}) - {t2}) / sqrt(2.0 / (9.0 * {a})))"
    # double literals: a decimal 1.0 / 3.0 would be cut to a few places
    return re.sub(r"\b(\d+\.\d+)\b", r"\1e0", f"({zs} * {zs} + {zk} * {zk})")


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b) by its continued fraction, vectorised over a and x."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma)
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    value = front * f
    return np.where(flip, 1 - value, value)


def pearson_p(df: DataFrame, r: str = "correlation", n: str = "n", out: str = "p_value") -> DataFrame:
    """Two-sided p-value of Pearson's r, on aggregated rows in Arrow batches."""

    @F.pandas_udf("double")
    def tail(rs: pd.Series, ns: pd.Series) -> pd.Series:
        dof = ns.to_numpy(float) - 2
        rr = np.clip(rs.to_numpy(float), -1, 1)
        ok = (dof > 0) & np.isfinite(rr)
        res = np.full(len(rr), np.nan)
        if ok.any():
            res[ok] = _incomplete_beta(dof[ok] / 2, 0.5, 1 - rr[ok] ** 2)
        return pd.Series(res)

    return df.withColumn(out, F.when(F.col(n) > 2, tail(r, F.col(n).cast("double"))))
