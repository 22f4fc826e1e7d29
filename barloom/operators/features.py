"""Model features over (symbol, date) series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.frames import decayed_sums, frame_values, interpolated, prev, rate, roll, running, running_product, series
from barloom.functions.rolling import NUMBERS, rolling_batches

ROLLING = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def date_parts(df: DataFrame, col: str = "date", extended: bool = False) -> DataFrame:
    d = F.col(col)
    quarter = F.trunc(d, "quarter")
    parts = {
        "day_of_week": F.weekday(d), "day_of_month": F.day(d), "week_of_year": F.weekofyear(d), "month": F.month(d),
        "quarter": F.quarter(d), "year": F.year(d), "is_month_start": (F.day(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"), "is_quarter_start": (d == quarter).cast("int"),
        "is_quarter_end": (d == F.last_day(F.add_months(quarter, 2))).cast("int")}
    if extended:
        angle = F.month(d) * (2 * math.pi / 12)
        parts |= {"is_year_start": (F.dayofyear(d) == 1).cast("int"),
                  "is_year_end": ((F.month(d) == 12) & (F.day(d) == 31)).cast("int"),
                  "is_weekend": (F.weekday(d) >= 5).cast("int"), "month_sin": F.sin(angle), "month_cos": F.cos(angle)}
    return df.withColumns(parts)


def lag_features(df: DataFrame, cols, lags) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": prev(c, k) for c in cols for k in lags})


def rolling_features(df: DataFrame, cols, windows, functions: dict | None = None) -> DataFrame:
    """``functions`` maps a name to an aggregate Column function; the default std is the population form.

    The default functions of number columns go over arrays of rows instead of one frame per row.
    """
    cols, windows = list(cols), list(windows)
    if not functions and cols and windows and all(isinstance(f.dataType, NUMBERS) for f in df.select(*cols).schema):
        return rolling_batches(df, cols, windows)
    fns = functions or ROLLING
    return df.withColumns({f"{c}_{name}_{n}": roll(fn, c, n) for c in cols for n in windows for name, fn in fns.items()})


def rolling_python(df: DataFrame, col: str, n: int, name: str, fn) -> DataFrame:
    """Arbitrary numpy function of the last n values, run in Arrow batches over bounded frames."""
    @F.pandas_udf("double")
    def apply(frames: pd.Series) -> pd.Series:
        return frames.map(lambda a: float(fn(np.asarray(a, dtype=float))))

    w = series().rowsBetween(-(n - 1), 0)
    frame = F.collect_list(col).over(w)
    df = df.withColumn("_f", frame)
    return df.withColumn(f"{col}_{name}_{n}", F.when(F.size("_f") == n, apply("_f"))).drop("_f")


def rolling_mean_std(df: DataFrame, col: str, windows) -> DataFrame:
    return rolling_features(df, [col], windows, {"rolling_mean": F.avg, "rolling_std": F.stddev_samp})


def return_features(df: DataFrame, col: str, periods=(1, 5, 10, 21, 63), log_returns: bool = True) -> DataFrame:
    new = {}
    for k in periods:
        ratio = F.try_divide(F.col(col), prev(col, k))
        new[f"return_{k}d"] = ratio - 1
        if log_returns:
            new[f"log_return_{k}d"] = F.ln(ratio)
    return df.withColumns(new)


def all_features(df: DataFrame, price: str = "close", volume: str | None = "volume", lags=(1, 2, 3, 5, 10),
                 windows=(5, 10, 21, 63), return_periods=(1, 5, 10, 21, 63), calendar=True, with_lags=True,
                 with_rolling=True, with_returns=True) -> DataFrame:
    cols = [price] + ([volume] if volume else [])
    # lags and returns share the partitions of the series; frames leave them, and what follows goes row by row
    start = df.columns
    df = lag_features(df, cols, lags) if with_lags else df
    lagged = df.columns
    df = return_features(df, price, return_periods) if with_returns else df
    returned = df.columns
    df = rolling_features(df, cols, windows) if with_rolling else df
    rolled = df.columns
    df = date_parts(df) if calendar else df
    return df.select(*start, *df.columns[len(rolled):], *lagged[len(start):], *rolled[len(returned):], *returned[len(lagged):])


def price_shape(df: DataFrame) -> DataFrame:
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return df.withColumns({
        "price_change": c - prev("close"), "pct_change": rate("close"), "log_return": F.ln(F.try_divide(c, prev("close"))),
        "high_low_range": h - lo, "high_low_range_pct": F.try_divide(h - lo, c), "open_close_range": c - o,
        "open_close_range_pct": F.try_divide(c - o, o), "upper_shadow": h - F.greatest(o, c),
        "lower_shadow": F.least(o, c) - lo, "body_size": F.abs(c - o), "volume_change": rate("volume"),
        "volume_relative": F.try_divide(v, roll(F.avg, "volume", 20))})


def target_variables(df: DataFrame, horizons=(1, 5, 10), col: str = "close") -> DataFrame:
    new = {}
    for k in horizons:
        future = F.lead(col, k).over(series())
        new[f"future_price_{k}d"] = future
        new[f"target_{k}d_return"] = F.try_divide(future, F.col(col)) - 1
        new[f"target_{k}d_direction"] = F.when(future.isNotNull(), (future > F.col(col)).cast("int"))
    return df.withColumns(new)


def model_features_a(df: DataFrame, cols=("close",), n: int = 10, horizon: int = 1) -> DataFrame:
    df = lag_features(df, cols, range(1, n + 1))
    new = {}
    for c in cols:
        for name, fn in {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items():
            new[f"{c}_rolling_{name}_{n}"] = roll(fn, c, n)
        new[f"{c}_pct_change"] = rate(c)
        new[f"{c}_pct_change_abs"] = F.abs(rate(c))
        new[f"{c}_target_{horizon}"] = F.lead(c, horizon).over(series())
    return df.withColumns(new).na.drop("any")


def model_features_b(df: DataFrame, col: str = "close", n: int = 10, horizon: int = 1) -> DataFrame:
    df = lag_features(df, [col], range(1, n + 1))
    keep = 1 - 2.0 / (n + 1)
    new = {f"{col}_rolling_{name}_{n}": roll(fn, col, n)
           for name, fn in {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items()}
    df = df.withColumns(new | {
        "_frame": frame_values(col, n), f"{col}_roc_{n}": rate(col, n) * 100, f"{col}_pct_change_1": rate(col),
        f"{col}_pct_change_5": rate(col, 5), f"{col}_abs_change": F.abs(F.col(col) - prev(col)),
        f"{col}_target_{horizon}": F.lead(col, horizon).over(series()), "_one": F.lit(1.0)})
    df = df.withColumns({
        f"{col}_rolling_median_{n}": F.when(F.size("_frame") == n, interpolated(F.col("_frame"), 0.5)),
        f"{col}_acceleration": rate(f"{col}_pct_change_1"), "day_of_week": F.weekday("date"), "month": F.month("date"),
        "day_of_month": F.day("date"), "quarter": F.quarter("date")})
    df = decayed_sums(df, [(F.col(col), "_num"), (F.col("_one"), "_den")], keep)
    df = df.withColumn(f"{col}_ema_{n}", F.col("_num") / F.col("_den"))
    return df.drop("_num", "_den", "_one", "_frame").na.drop("any")


def sequences(df: DataFrame, cols, n: int) -> DataFrame:
    """Windows of the n rows before each row, with the row itself as label."""
    item = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
    w = series().rowsBetween(-n, -1)
    df = df.withColumns({"window": F.collect_list(item).over(w), "label": item})
    return df.where(F.size("window") == n)


def rolling_sharpe(df: DataFrame, n: int = 12, rf: float = 0.0, col: str = "ret") -> DataFrame:
    value = F.try_divide(roll(F.avg, col, n) - rf, roll(F.stddev_samp, col, n))
    return df.withColumn("rolling_sharpe", F.coalesce(value, F.lit(0.0)))


def rolling_stats(df: DataFrame, n: int = 252, col: str = "ret") -> DataFrame:
    df = df.withColumns({"rolling_return": roll(F.avg, col, n) * 252,
                         "rolling_volatility": roll(F.stddev_samp, col, n) * math.sqrt(252)})
    return df.withColumn("rolling_sharpe", F.try_divide(F.col("rolling_return"), F.col("rolling_volatility")))


def rolling_metrics(df: DataFrame, n: int = 60, rf: float = 0.0, col: str = "ret") -> DataFrame:
    """Rolling portfolio sheet; the drawdown is the worst fall inside the frame from its own running peak."""
    w = series().rowsBetween(-(n - 1), 0)
    down = F.when(F.col(col) < 0, F.col(col))
    df = df.withColumns({
        "returns": roll(F.avg, col, n) * 252, "volatility": roll(F.stddev_samp, col, n) * math.sqrt(252),
        "downside_risk": F.when(F.count(col).over(w) >= n, F.stddev_samp(down).over(w)) * math.sqrt(252),
        "_frame": F.collect_list(col).over(w)})
    step = lambda acc, r: F.struct(
        (acc["v"] * (1 + r)).alias("v"), F.greatest(acc["p"], acc["v"] * (1 + r)).alias("p"),
        F.least(acc["d"], acc["v"] * (1 + r) / F.greatest(acc["p"], acc["v"] * (1 + r)) - 1).alias("d"))
    start = F.struct(F.lit(1.0).alias("v"), F.lit(0.0).alias("p"), F.lit(0.0).alias("d"))
    worst = F.aggregate("_frame", start, step, lambda acc: acc["d"])
    return df.withColumns({
        "sharpe_ratio": F.try_divide(F.col("returns") - rf, F.col("volatility")),
        "sortino_ratio": F.try_divide(F.col("returns") - rf, F.col("downside_risk")),
        "max_drawdown": F.when(F.size("_frame") >= n, worst)}).drop("_frame")


def drawdown_series(df: DataFrame, price: str = "close") -> DataFrame:
    """Running fall from the highest price so far, and cumulative return from the first price."""
    first = F.first(price).over(series().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns({"drawdown": F.try_divide(F.col(price), running(F.max, price)) - 1,
                           "cumulative_return": F.try_divide(F.col(price), first) - 1})


def cumulative_return(df: DataFrame, col: str = "ret", out: str = "cumulative") -> DataFrame:
    return df.withColumn(out, running_product(1 + F.col(col)) - 1)
