"""Classical seasonal decomposition of (symbol, date) series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.frames import series

ROWS_PER_CYCLE = {"daily": 5, "weekly": 52, "monthly": 12, "quarterly": 4}


def decompose(df: DataFrame, col: str = "close", period: str = "monthly", method: str = "additive") -> DataFrame:
    """Adds trend, seasonal and residual.  Trend is the centred mean over one cycle (half weights at both ends
    of an even cycle); seasonal is the mean detrended value of a phase, centred over the phases."""
    n = ROWS_PER_CYCLE[period]
    half = n // 2
    w = series()
    wide = F.sum(col).over(w.rowsBetween(-half, half))
    if n % 2 == 0:
        wide = wide - (F.lag(col, half).over(w) + F.lead(col, half).over(w)) / 2
    full = F.count(col).over(w.rowsBetween(-half, half)) == 2 * half + 1
    df = df.withColumns({"trend": F.when(full, wide / n), "_phase": (F.row_number().over(w) - 1) % n})
    off = F.col(col) - F.col("trend") if method == "additive" else F.try_divide(F.col(col), F.col("trend"))
    df = df.withColumn("_mean", F.avg(off).over(W.partitionBy("symbol", "_phase")))
    one_per_phase = F.row_number().over(W.partitionBy("symbol", "_phase").orderBy("date")) == 1
    df = df.withColumn("_rep", F.when(one_per_phase, F.col("_mean")))
    centre = F.avg("_rep").over(W.partitionBy("symbol"))
    if method == "additive":
        df = df.withColumn("seasonal", F.col("_mean") - centre)
        df = df.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal"))
    else:
        df = df.withColumn("seasonal", F.try_divide(F.col("_mean"), centre))
        df = df.withColumn("residual", F.try_divide(F.col(col), F.col("trend") * F.col("seasonal")))
    return df.drop("_phase", "_mean", "_rep")


def strength(df: DataFrame, method: str = "additive") -> DataFrame:
    base = 0.0 if method == "additive" else 1.0
    s, r = F.avg(F.abs(F.col("seasonal") - base)), F.avg(F.abs(F.col("residual") - base))
    return df.groupBy("symbol").agg(F.coalesce(F.try_divide(s, r), F.lit(0.0)).alias("seasonality_strength"))


def pattern(df: DataFrame, period: str = "monthly") -> DataFrame:
    """Mean seasonal value per calendar month, weekday or quarter."""
    unit = {"monthly": F.month("date"), "weekly": F.weekday("date"), "quarterly": F.quarter("date")}[period]
    return df.groupBy("symbol", unit.alias("unit")).agg(F.avg("seasonal").alias("pattern"))
