"""Technical indicators over bars(symbol, date, open, high, low, close, volume).

All functions add columns and keep every row.  Windows share one partitioning and order; two-stage indicators
use a nested select on the same order, so they add no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import decayed_sums, ewm, ewm_many, prev, roll, running, series


def sma(df: DataFrame, n: int = 20, col: str = "close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma_{n}", roll(F.avg, col, n))


def ema(df: DataFrame, n: int = 20, col: str = "close", out: str | None = None) -> DataFrame:
    return ewm(df, col, n, out or f"ema_{n}")


def ema_adjusted(df: DataFrame, n: int, col: str = "close", out: str | None = None) -> DataFrame:
    """Weighted mean with weights a^k over all values so far; nulls have no weight."""
    df = decayed_sums(df, [(F.col(col), "_num"), (F.when(F.col(col).isNotNull(), 1.0), "_den")], 1 - 2.0 / (n + 1), on=col)
    return df.withColumn(out or f"ema_adj_{n}", F.col("_num") / F.col("_den")).drop("_num", "_den")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close") -> DataFrame:
    if min(fast, slow, signal) <= 0:
        raise ValueError("periods must be positive integers")
    if fast >= slow:
        raise ValueError("fast period must be less than slow period")
    df = ewm_many(df, [(col, fast, "_fast"), (col, slow, "_slow")])
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, "macd_line", signal, "macd_signal")
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def rsi(df: DataFrame, n: int = 14, col: str = "close", out: str | None = None) -> DataFrame:
    """Simple-mean RSI; the first row's change counts as zero.  No loss: 100 with gains, null without."""
    step = F.coalesce(F.col(col) - prev(col), F.lit(0.0))
    df = df.withColumn("_d", step)
    gain = roll(F.avg, F.greatest(F.col("_d"), F.lit(0.0)), n)
    loss = roll(F.avg, F.greatest(-F.col("_d"), F.lit(0.0)), n)
    df = df.withColumn("_g", gain).withColumn("_l", loss)
    value = F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).otherwise(
        100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_g"), F.col("_l"))))
    return df.withColumn(out or f"rsi_{n}", value).drop("_d", "_g", "_l")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, col: str = "close") -> DataFrame:
    if k <= 0:
        raise ValueError("standard deviation multiplier must be positive")
    mid, sd = roll(F.avg, col, n), roll(F.stddev_samp, col, n)
    df = df.withColumn("bb_middle", mid).withColumn("_sd", sd)
    df = df.withColumn("bb_upper", F.col("bb_middle") + k * F.col("_sd"))
    df = df.withColumn("bb_lower", F.col("bb_middle") - k * F.col("_sd")).drop("_sd")
    width = F.col("bb_upper") - F.col("bb_lower")
    return (df.withColumn("bb_bandwidth", F.try_divide(width, F.col("bb_middle")))
              .withColumn("bb_percent_b", F.try_divide(F.col(col) - F.col("bb_lower"), width)))


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = roll(F.min, "low", k), roll(F.max, "high", k)
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    df = df.withColumn("stoch_k", 100 * F.try_divide(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return df.withColumn("stoch_d", roll(F.avg, "stoch_k", d)).drop("_lo", "_hi")


def true_range() -> Column:
    back = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - back), F.abs(F.col("low") - back))


def atr_sma(df: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    return df.withColumn("_tr", true_range()).withColumn(out or f"atr_{n}", roll(F.avg, "_tr", n)).drop("_tr")


def atr_ema(df: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    return ewm(df.withColumn("_tr", true_range()), "_tr", n, out or f"atr_{n}").drop("_tr")


def adx(df: DataFrame, n: int = 14, raw_dm: bool = False) -> DataFrame:
    """Directional index.  ``raw_dm`` masks the falling move against the already masked rising move."""
    up = F.col("high") - prev("high")
    down = prev("low") - F.col("low")
    df = df.withColumn("_tr", true_range()).withColumn("_up", up).withColumn("_dn", down)
    zero = F.lit(0.0)
    df = df.withColumn("_p", F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(zero))
    rival = F.col("_p") if raw_dm else F.col("_up")
    df = df.withColumn("_m", F.when((F.col("_dn") > rival) & (F.col("_dn") > 0), F.col("_dn")).otherwise(zero))
    df = df.withColumn("_st", roll(F.sum, "_tr", n))
    df = df.withColumn("pos_di", 100 * F.try_divide(roll(F.sum, "_p", n), F.col("_st")))
    df = df.withColumn("neg_di", 100 * F.try_divide(roll(F.sum, "_m", n), F.col("_st")))
    df = df.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("pos_di") - F.col("neg_di")),
                                                 F.col("pos_di") + F.col("neg_di")))
    return df.withColumn("adx", roll(F.avg, "_dx", n)).drop("_tr", "_up", "_dn", "_p", "_m", "_st", "_dx")


def obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)).cast("bigint") * F.col("volume")
    return df.withColumn("_s", step).withColumn("obv", running(F.sum, "_s")).drop("_s")


def ichimoku(df: DataFrame, conversion: int = 9, base: int = 26, span_b: int = 52, shift: int = 26) -> DataFrame:
    mid = {n: (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2 for n in (conversion, base, span_b)}
    df = (df.withColumn("tenkan_sen", mid[conversion]).withColumn("kijun_sen", mid[base]).withColumn("_b", mid[span_b]))
    return (df.withColumn("senkou_span_a", F.lag((F.col("tenkan_sen") + F.col("kijun_sen")) / 2, shift).over(series()))
              .withColumn("senkou_span_b", F.lag("_b", shift).over(series()))
              .withColumn("chikou_span", F.lead("close", shift).over(series())).drop("_b"))


def keltner(df: DataFrame, n: int = 20, atr_n: int = 10, k: float = 2.0, atr_mode: str = "ema") -> DataFrame:
    if k <= 0:
        raise ValueError("multiplier must be positive")
    df = ewm(df, "close", n, "keltner_middle")
    df = (atr_ema if atr_mode == "ema" else atr_sma)(df, atr_n, "_atr")
    return (df.withColumn("keltner_upper", F.col("keltner_middle") + k * F.col("_atr"))
              .withColumn("keltner_lower", F.col("keltner_middle") - k * F.col("_atr")).drop("_atr"))


def volatility_multi(df: DataFrame, periods=(5, 10, 20, 30, 60), col: str = "close", log_returns: bool = True) -> DataFrame:
    ratio = F.try_divide(F.col(col), prev(col))
    df = df.withColumn("_r", F.ln(ratio) if log_returns else ratio - 1)
    for n in periods:
        df = df.withColumn(f"volatility_{n}", roll(F.stddev_samp, "_r", n) * math.sqrt(252))
    return df.drop("_r")


def trend_mas(df: DataFrame, ma=(20, 50, 100, 200), em=(12, 26, 50, 100), col: str = "close") -> DataFrame:
    df = df.withColumns({f"sma_{n}": roll(F.avg, col, n) for n in ma})
    df = ewm_many(df, [(col, n, f"ema_{n}") for n in em])
    new = {}
    for kind, periods in (("sma", ma), ("ema", em)):
        for n in periods:
            new[f"price_rel_{kind}_{n}"] = F.try_divide(F.col(col), F.col(f"{kind}_{n}")) - 1
        for a, b in zip(periods, periods[1:]):
            new[f"{kind}_{a}_{b}_diff"] = F.col(f"{kind}_{a}") - F.col(f"{kind}_{b}")
    return df.withColumns(new)


def all_indicators(df: DataFrame) -> DataFrame:
    """Every indicator in one table, staged by dependency so that a stage is one window pass over the series.

    The same definitions as the single functions, for bars without null prices.
    """
    def r(agg, x, n):
        return roll(agg, x, n)

    c, hi, lo, zero = F.col("close"), F.col("high"), F.col("low"), F.lit(0.0)
    mid = {n: (r(F.max, "high", n) + r(F.min, "low", n)) / 2 for n in (9, 26, 52)}
    df = df.withColumns({
        "_tr": true_range(), "_up": hi - prev("high"), "_dn": prev("low") - lo, "_d": F.coalesce(c - prev("close"), zero),
        "sma_20": r(F.avg, "close", 20), "sma_50": r(F.avg, "close", 50), "sma_200": r(F.avg, "close", 200),
        "_sd": r(F.stddev_samp, "close", 20), "_lo": r(F.min, "low", 14), "_hi": r(F.max, "high", 14),
        "tenkan_sen": mid[9], "kijun_sen": mid[26], "_sb": mid[52], "chikou_span": F.lead("close", 26).over(series())})
    df = df.withColumns({
        "stoch_k": 100 * F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo")),
        "_p": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(zero),
        "_m": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(zero),
        "_step": F.signum("_d").cast("bigint") * F.col("volume"),
        "_sa": (F.col("tenkan_sen") + F.col("kijun_sen")) / 2})
    df = df.withColumns({
        "_g": r(F.avg, F.greatest(F.col("_d"), zero), 14), "_l": r(F.avg, F.greatest(-F.col("_d"), zero), 14),
        "_st": r(F.sum, "_tr", 14), "_sp": r(F.sum, "_p", 14), "_sm": r(F.sum, "_m", 14),
        "stoch_d": roll(F.avg, "stoch_k", 3), "obv": running(F.sum, "_step"),
        "senkou_span_a": F.lag("_sa", 26).over(series()), "senkou_span_b": F.lag("_sb", 26).over(series())})
    df = df.withColumns({"pos_di": 100 * F.try_divide(F.col("_sp"), F.col("_st")),
                         "neg_di": 100 * F.try_divide(F.col("_sm"), F.col("_st"))})
    df = df.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("pos_di") - F.col("neg_di")), F.col("pos_di") + F.col("neg_di")))
    width = 4 * F.col("_sd")
    df = df.withColumns({
        "adx": roll(F.avg, "_dx", 14), "bb_middle": F.col("sma_20"),
        "bb_upper": F.col("sma_20") + 2 * F.col("_sd"), "bb_lower": F.col("sma_20") - 2 * F.col("_sd"),
        "bb_bandwidth": F.try_divide(width, F.col("sma_20")),
        "bb_percent_b": F.try_divide(c - (F.col("sma_20") - 2 * F.col("_sd")), width),
        "rsi_14": F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).otherwise(
            100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_g"), F.col("_l"))))})
    df = df.drop("_up", "_dn", "_d", "_sd", "_lo", "_hi", "_sb", "_p", "_m", "_step", "_sa", "_g", "_l", "_st", "_sp", "_sm", "_dx")
    df = ewm_many(df, [("close", 12, "ema_12"), ("close", 26, "ema_26"), ("close", 20, "keltner_middle"),
                       ("_tr", 14, "atr_14"), ("_tr", 10, "_a10")])
    df = df.withColumns({"macd_line": F.col("ema_12") - F.col("ema_26"),
                         "keltner_upper": F.col("keltner_middle") + 2 * F.col("_a10"),
                         "keltner_lower": F.col("keltner_middle") - 2 * F.col("_a10")}).drop("_tr", "_a10")
    return ewm(df, "macd_line", 9, "macd_signal").withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))
