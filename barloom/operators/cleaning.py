"""Validation, cleaning, scaling and balancing of tables."""

from __future__ import annotations

from collections.abc import Callable

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.frames import series
from barloom.functions.order import quantile_map, with_row_index
from barloom.sources.readers import materialize

BAR_RULES = {"open_positive": "open", "high_positive": "high", "low_positive": "low", "close_positive": "close"}


def validate_bars(df: DataFrame) -> DataFrame:
    """Violations per rule: prices above zero, volume not negative, values that do not parse as numbers."""
    price = {r: F.count_if(~F.coalesce(F.col(c).try_cast("double") > 0, F.lit(False))) for r, c in BAR_RULES.items()}
    volume = F.count_if(~F.coalesce(F.col("volume").try_cast("double") >= 0, F.lit(False)))
    return _long(df.agg(F.count("*").alias("rows"), volume.alias("volume_not_negative"), *[c.alias(r) for r, c in price.items()]), "rows")


def _long(one: DataFrame, total: str) -> DataFrame:
    rules = [c for c in one.columns if c != total]
    lines = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules]))
    return one.select(total, lines.alias("x")).select("x.rule", "x.violations", total)


def validate_returns(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if((F.col("ret") < -1) | (F.col("ret") > 1)).alias("violations")).withColumn(
        "valid", F.col("violations") == 0)


def validate_portfolio(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    out = weights.groupBy("portfolio_id").agg(F.count("*").alias("assets"), F.sum(w).alias("total_weight"), F.count_if((w < 0) | (w > 1)).alias("out_of_range"),
                                              F.count_if(w.isNull() | F.col("symbol").isNull()).alias("missing_fields"))
    ok = F.col("total_weight").between(0.99, 1.01) & (F.col("out_of_range") == 0) & (F.col("missing_fields") == 0)
    return out.withColumn("valid", ok)


# Allowed range per indicator column (inclusive flags in the last place).
INDICATOR_RULES = [("SMA", 0.0, None, False), ("EMA", 0.0, None, False), ("RSI", 0.0, 100.0, True), ("BBANDS", 0.0, None, False), ("MACD", None, None, True)]


def validate_indicator(long: DataFrame) -> DataFrame:
    """Violations of the range rule of each indicator; rows are (indicator, value)."""
    rules = long.sparkSession.createDataFrame(INDICATOR_RULES, "indicator string, lo double, hi double, inclusive boolean")
    df = long.join(F.broadcast(rules), "indicator", "left")
    v = F.col("value")
    low = F.when(F.col("inclusive"), v < F.col("lo")).otherwise(v <= F.col("lo"))
    bad = F.coalesce(low, F.lit(False)) | F.coalesce(v > F.col("hi"), F.lit(False)) | v.isNull()
    return df.groupBy("indicator").agg(F.count("*").alias("rows"), F.count_if(bad).alias("violations"))


def check_integrity(df: DataFrame, required: list[str], min_rows: int = 1, allow_nulls: bool = False) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in required if c in df.columns), F.lit(0))
    out = df.agg(F.count("*").alias("row_count"), nulls.cast("bigint").alias("null_count")).withColumn("missing_columns", F.lit(",".join(missing)))
    ok = (F.col("row_count") >= min_rows) & F.lit(not missing)
    return out.withColumn("valid", ok if allow_nulls else ok & (F.col("null_count") == 0))


def clean_bars(df: DataFrame, prices=("open", "high", "low", "close")) -> DataFrame:
    """Drops rows with a null price and flags prices that are not positive or a negative volume."""
    df = df.na.drop("any", subset=list(prices))
    bad = F.least(*prices) <= 0
    return df.withColumn("suspect", F.coalesce(bad | (F.col("volume") < 0), F.lit(False)))


def clean_quarterly(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def clean_shareholding(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=cols)


def clean_news(df: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return df.where(filled("title") & filled("url"))


def fill_median_ffill(df: DataFrame, numeric: list[str], other: list[str], key: str = "symbol", time: str = "date") -> DataFrame:
    """Numeric nulls to the column median, other nulls forward then backward along the series.

    A row without a value before it is one of the first rows, so what it takes from behind is the first value of its series:
    one value per series, found once.
    """
    m = quantile_map(df, numeric, [0.5])
    w = series(key, time)
    before, whole = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("_m", m)
    fills = {c: F.coalesce(F.col(c).cast("double"), F.col("_m")[f"{c}@0.5"]) for c in numeric}
    fills |= {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole)) for c in other}
    return df.withColumns(fills).drop("_m")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _fences(df: DataFrame, cols: list[str], factor: float):
    df = df.withColumn("_q", quantile_map(df, cols, [0.25, 0.75]))
    q = lambda c, p: F.col("_q")[f"{c}@{p}"]
    span = lambda c: q(c, 0.75) - q(c, 0.25)
    return df, {c: (q(c, 0.25) - factor * span(c), q(c, 0.75) + factor * span(c)) for c in cols}


def clip_iqr(df: DataFrame, cols: list[str], factor: float = 3.0) -> DataFrame:
    df, fence = _fences(df, cols, factor)
    return df.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), lo), hi) for c, (lo, hi) in fence.items()}).drop("_q")


def _moments(df: DataFrame, cols: list[str], aggs: dict) -> Column:
    return df.agg(F.struct(*[f(c).cast("double").alias(f"{c}_{n}") for c in cols for n, f in aggs.items()])).scalar()


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    df = df.withColumn("_s", _moments(df, cols, {"lo": F.min, "hi": F.max}))
    g = lambda c, n: F.col("_s")[f"{c}_{n}"]
    return df.withColumns({c: F.when(g(c, "hi") > g(c, "lo"), (F.col(c) - g(c, "lo")) / (g(c, "hi") - g(c, "lo"))).otherwise(
        F.col(c).cast("double")) for c in cols}).drop("_s")


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale by the population std of ``fit_on`` (the training rows)."""
    df = df.withColumn("_s", _moments(fit_on if fit_on is not None else df, cols, {"m": F.avg, "sd": F.stddev_pop}))
    g = lambda c, n: F.col("_s")[f"{c}_{n}"]
    return df.withColumns({c: (F.col(c) - g(c, "m")) / F.when(g(c, "sd") > 0, g(c, "sd")).otherwise(1.0) for c in cols}).drop("_s")


def outlier_flag(df: DataFrame, cols: list[str], method: str = "zscore", threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    """True where any column is outside the global z-score or quartile fences."""
    if method == "zscore":
        df = df.withColumn("_q", _moments(df, cols, {"m": F.avg, "sd": F.stddev_pop}))
        tests = [F.abs(F.try_divide(F.col(c) - F.col("_q")[f"{c}_m"], F.col("_q")[f"{c}_sd"])) >= threshold for c in cols]
    elif method == "iqr":
        df, fence = _fences(df, cols, 1.5)
        tests = [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in fence.items()]
    else:
        raise ValueError(f"unknown outlier method: {method}")
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return df.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_q")


def remove_outliers(df: DataFrame, cols: list[str], method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    return outlier_flag(df, cols, method, threshold, "_out").where("NOT _out").drop("_out")


def feature_chain(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """Applies named steps in order; also returns the log (step, rows after) as a lazy table."""
    logs = []
    for i, (name, fn) in enumerate(steps):
        df = df.transform(fn)
        logs.append(df.agg(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.count("*").alias("rows")))
    log = logs[0]
    for other in logs[1:]:
        log = log.unionByName(other)
    return df, log


def smote_balance(df: DataFrame, key: str, label: str, cols: list[str], k: int = 5, seed: int = 42, block: int = 1024) -> DataFrame:
    """Adds interpolated rows to the smaller of two classes until both are equal.

    Minority rows are laid out by a projection of their scaled features and cut into blocks of a fixed size;
    neighbours are the k nearest rows of the same block.  How many new rows each one seeds follows from its
    global position, so the classes come out exactly equal.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    small = counts.agg(F.min_by(label, F.struct("n", label))).scalar()
    need = (counts.agg(F.max("n")).scalar() - counts.agg(F.min("n")).scalar())
    have = counts.agg(F.min("n")).scalar()
    minority = df.where(F.col(label) == small).select(key, label, *[F.col(c).cast("double").alias(c) for c in cols])
    scaled = standard_scale(minority, cols).select(key, sum(F.col(c) for c in cols).alias("_p"))
    rows = with_row_index(materialize(minority.join(scaled, key), "minority"), "_p", [key], "_i")
    rows = rows.withColumns({"_need": need, "_have": have})
    rows = rows.withColumn("_copies", (F.floor(F.col("_need") / F.col("_have")) + (F.col("_i") < F.col("_need") % F.col("_have")).cast("int")).cast("int"))
    kind = dict(df.dtypes)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i").reset_index(drop=True)
        x = pdf[cols].to_numpy(float)
        sd = x.std(axis=0)
        z = x / np.where(sd > 0, sd, 1)
        d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(k, len(x) - 1))]
        out = []
        for r in range(len(x)):
            rng = np.random.default_rng([seed, int(pdf["_i"][r])])
            for c in range(int(pdf["_copies"][r])):
                other = x[near[r, rng.integers(near.shape[1])]] if len(x) > 1 else x[r]
                out.append((pdf[key][r], pdf[label][r], c + 1, *(x[r] + rng.random() * (other - x[r]))))
        return pd.DataFrame(out, columns=[key, label, "copy", *cols])

    schema = f"{key} {kind[key]}, {label} {kind[label]}, copy int, " + ", ".join(f"{c} double" for c in cols)
    new = rows.withColumn("_blk", F.floor(F.col("_i") / block)).groupBy("_blk").applyInPandas(grow, schema)
    old = df.select(key, label, F.lit(0).alias("copy"), *[F.col(c).cast("double").alias(c) for c in cols])
    return old.unionByName(new)
