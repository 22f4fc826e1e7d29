"""Regimes, events, trend classes and trading signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.frames import ewm_many, prev, rate, roll, running, series
from barloom.operators.indicators import adx as add_adx
from barloom.operators.indicators import all_indicators


def last_row(df: DataFrame) -> DataFrame:
    """The newest row of every symbol, as a mergeable aggregate over whole rows."""
    rest = [c for c in df.columns if c != "symbol"]
    top = df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("r"))
    return top.select("symbol", *[F.col(f"r.{c}").alias(c) for c in rest])


def _gap(a: str, b) -> tuple[Column, Column]:
    """Difference now and one row ago, at nine places so that equal values summed in another order stay equal."""
    gap = F.round(F.col(a) - (F.col(b) if isinstance(b, str) else F.lit(b)), 9)
    return gap, prev(gap)


def crosses_above(a: str, b) -> Column:
    now, was = _gap(a, b)
    return F.coalesce((now > 0) & (was <= 0), F.lit(False))


def crosses_below(a: str, b) -> Column:
    now, was = _gap(a, b)
    return F.coalesce((now < 0) & (was >= 0), F.lit(False))


def market_regime(df: DataFrame, n: int = 63) -> DataFrame:
    first = F.first("close").over(series().rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({
        **{f"sma_{k}": roll(F.avg, "close", k) for k in (20, 50, 200)},
        "_short": roll(F.avg, "close", n), "_long": roll(F.avg, "close", 2 * n),
        "_ret": rate("close"), "_cum": F.when(prev("close").isNotNull(), F.try_divide(F.col("close"), first) - 1)})
    df = df.withColumns({"current_volatility": roll(F.stddev_samp, "_ret", n) * math.sqrt(252), "_cumavg": roll(F.avg, "_cum", n)})
    df = df.withColumn("historical_volatility", roll(F.avg, "current_volatility", 2 * n))
    tests = [F.col("close") > F.col("sma_200"), F.col("sma_50") > F.col("sma_200"), F.col("sma_20") > F.col("sma_50"),
             F.col("_short") > F.col("_long"), F.col("_cumavg") > 0]
    score = sum(F.coalesce(x, F.lit(False)).cast("int") for x in tests) / F.lit(5.0)
    out = last_row(df.select("symbol", "date", "current_volatility", "historical_volatility", score.alias("bullish_score")))
    vol, hist, s = F.col("current_volatility"), F.col("historical_volatility"), F.col("bullish_score")
    return out.withColumns({
        "regime": F.when(s >= 0.7, "Bullish").when(s <= 0.3, "Bearish").otherwise("Neutral"),
        "volatility_regime": F.when(vol > hist * 1.5, "High").when(vol < hist * 0.5, "Low").otherwise("Normal"),
        "trend_strength": F.abs(s - 0.5) * 2})


def market_events(df: DataFrame, move: float = 0.03) -> DataFrame:
    """Crosses of the 50- and 200-row means and large daily moves, one row per event."""
    df = df.withColumns({"sma_50": roll(F.avg, "close", 50), "sma_200": roll(F.avg, "close", 200),
                         "change": rate("close")})
    def event(when, kind, significance, value):
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(significance).alias("significance"),
                                     value.cast("double").alias("change")))
    none = F.lit(None)
    events = F.array_compact(F.array(
        event(crosses_above("sma_50", "sma_200"), "Golden Cross", "Bullish", none),
        event(crosses_below("sma_50", "sma_200"), "Death Cross", "Bearish", none),
        event(F.abs("change") >= move, "Large Daily Move", "High Volatility", F.col("change"))))
    return df.select("symbol", "date", events.alias("e")).select("symbol", "date", F.explode("e").alias("e")).select(
        "symbol", "date", "e.type", "e.significance", "e.change")


def trend_strength(df: DataFrame, n: int = 63) -> DataFrame:
    """Trend over the last ``n`` rows of every symbol; the fit is an aggregate over those rows alone."""
    df = add_adx(df)
    w = series()
    df = df.withColumns({"_i": F.row_number().over(w).cast("double"), "_up": (rate("close") > 0).cast("double"), "_n": F.count("*").over(W.partitionBy("symbol"))})
    df = df.where((F.col("_n") >= n) & (F.col("_i") > F.col("_n") - n))
    out = df.groupBy("symbol").agg(
        F.regr_slope("close", "_i").alias("_slope"), F.regr_r2("close", "_i").alias("r_squared"), F.min_by("close", "_i").alias("_base"),
        F.avg(F.coalesce("_up", F.lit(0.0))).alias("_pos"), F.max_by("adx", "_i").alias("adx"))
    out = out.withColumns({"slope": F.try_divide(F.col("_slope"), F.col("_base")) * 100,
                           "directional_consistency": F.greatest(F.col("_pos"), 1 - F.col("_pos"))})
    score = (F.col("slope") / 10 + F.col("r_squared") + F.col("adx") / 100 + F.col("directional_consistency")) / 4
    return out.withColumn("trend_strength", score).select(
        "symbol", "slope", "r_squared", "adx", "directional_consistency", "trend_strength")


def trend_class(df: DataFrame, short: int = 20, medium: int = 50, long: int = 200) -> DataFrame:
    names = {"short": short, "medium": medium, "long": long}
    df = add_adx(df, raw_dm=True)
    df = df.withColumns({f"sma_{k}": roll(F.avg, "close", n) for k, n in names.items()})
    df = df.withColumn("_x", F.col("sma_short") - F.col("sma_medium"))
    df = df.withColumns({"trend_slope": (F.col("sma_long") - prev("sma_long", 20)) / 20, "_px": prev("_x")})
    df = ewm_many(df, [("close", n, f"ema_{k}") for k, n in names.items()])
    out = last_row(df.select("symbol", "date", "close", "adx", "trend_slope", "_x", "_px",
                             *[f"sma_{k}" for k in names], *[f"ema_{k}" for k in names]))
    c, s, m, g, slope = (F.col(x) for x in ("close", "sma_short", "sma_medium", "sma_long", "trend_slope"))
    up = ((c > s) & (s > m) & (m > g)) | ((c > s) & (c > m) & (c > g) & (slope > 0))
    down = ((c < s) & (s < m) & (m < g)) | ((c < s) & (c < m) & (c < g) & (slope < 0))
    return out.withColumns({
        "trend": F.when(up, "uptrend").when(down, "downtrend").when(slope > 0, "weak_uptrend")
                  .when(slope < 0, "weak_downtrend").otherwise("sideways"),
        "trend_strength": F.try_divide(F.abs(slope) * long, c),
        **{f"price_to_sma_{k}": F.try_divide(c, F.col(f"sma_{k}")) - 1 for k in names},
        "golden_cross": F.coalesce((F.col("_x") > 0) & (F.col("_px") <= 0), F.lit(False)),
        "death_cross": F.coalesce((F.col("_x") < 0) & (F.col("_px") >= 0), F.lit(False))}).drop("_x", "_px")


def trend_direction(df: DataFrame, periods=(20, 50, 200)) -> DataFrame:
    periods = sorted(periods)
    df = add_adx(df).withColumns({f"ma_{n}": roll(F.avg, "close", n) for n in periods})
    out = last_row(df.select("symbol", "date", "close", "adx", *[f"ma_{n}" for n in periods]))
    a, b, x = F.col(f"ma_{periods[0]}"), F.col(f"ma_{periods[-1]}"), F.col("adx")
    out = out.withColumns({
        "trend_direction": F.when(a > b, "Bullish").when(a < b, "Bearish").otherwise("Neutral"),
        "_s": F.when(a > b, F.try_divide(a, b) - 1).when(a < b, 1 - F.try_divide(a, b)).otherwise(0.0)})
    s = F.col("_s")
    strength = F.when(x.isNull(), s).when(x < 20, F.least(s, F.lit(0.2))).when(x < 30, F.greatest(s, F.lit(0.5))).when(
        x < 50, F.greatest(s, F.lit(0.8))).otherwise(F.greatest(s, F.lit(1.0)))
    vs = {f"vs_ma_{n}": F.coalesce(F.try_divide(F.col("close"), F.col(f"ma_{n}")) - 1, F.lit(0.0)) for n in periods}
    return out.withColumns({"trend_strength": strength, **vs}).drop("_s")


BUY = ["macd_bullish_cross", "rsi_oversold", "stoch_bullish_cross", "golden_cross", "bb_lower_breakdown"]
SELL = ["macd_bearish_cross", "rsi_overbought", "stoch_bearish_cross", "death_cross", "bb_upper_breakout"]


def trading_signals(df: DataFrame) -> DataFrame:
    df = all_indicators(df)
    rules = {
        "golden_cross": crosses_above("sma_50", "sma_200"), "death_cross": crosses_below("sma_50", "sma_200"),
        "macd_bullish_cross": crosses_above("macd_line", "macd_signal"),
        "macd_bearish_cross": crosses_below("macd_line", "macd_signal"),
        "rsi_oversold": crosses_above("rsi_14", 30.0), "rsi_overbought": crosses_below("rsi_14", 70.0),
        "bb_upper_breakout": crosses_above("close", "bb_upper"), "bb_lower_breakdown": crosses_below("close", "bb_lower"),
        "stoch_bullish_cross": crosses_above("stoch_k", "stoch_d") & (F.col("stoch_k") < 50),
        "stoch_bearish_cross": crosses_below("stoch_k", "stoch_d") & (F.col("stoch_k") > 50),
        "adx_strong_trend": crosses_above("adx", 25.0),
        "volume_spike": F.coalesce(F.col("volume") > 2 * roll(F.avg, "volume", 20), F.lit(False))}
    out = df.select("symbol", "date", F.col("close").alias("price"), *[c.alias(n) for n, c in rules.items()])
    count = lambda names: sum(F.col(n).cast("int") for n in names)
    out = out.withColumns({
        "buy_signal": F.col("macd_bullish_cross") | F.col("rsi_oversold") | F.col("stoch_bullish_cross"),
        "sell_signal": F.col("macd_bearish_cross") | F.col("rsi_overbought") | F.col("stoch_bearish_cross"),
        "buy_count": count(BUY), "sell_count": count(SELL)})
    return out.withColumns({"strong_buy": F.col("buy_count") >= 2, "strong_sell": F.col("sell_count") >= 2})


def signal_effectiveness(signals: DataFrame, days: int = 20) -> DataFrame:
    """Return over the next ``days`` rows (to the last row near the end) after each kind of signal."""
    w = series()
    last = F.last("price").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    fwd = (F.try_divide(F.coalesce(F.lead("price", days).over(w), last), F.col("price")) - 1) * 100
    kinds = BUY + SELL + ["strong_buy", "strong_sell"]
    fired = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))
    rows = signals.select("symbol", fwd.alias("r"), fired.alias("k")).select("symbol", "r", F.explode("k").alias("signal"))
    rising = F.col("signal").isin(*BUY, "strong_buy")
    win = F.when(rising, F.col("r") > 0).otherwise(F.col("r") < 0)
    return rows.groupBy("signal").agg(
        F.count("*").alias("count"), F.avg("r").alias("avg_return"), F.max("r").alias("max_return"),
        F.min("r").alias("min_return"), (F.avg(win.cast("double")) * 100).alias("win_rate"))


def ma_signal(df: DataFrame) -> DataFrame:
    df = df.withColumns({"sma_20": roll(F.avg, "close", 20), "sma_50": roll(F.avg, "close", 50)})
    c, a, b = F.col("close"), F.col("sma_20"), F.col("sma_50")
    return last_row(df.select("symbol", "date", "close", "sma_20", "sma_50")).withColumn(
        "label", F.when((c > b) & (a > b), "Bullish").when((c < b) & (a < b), "Bearish").otherwise("Neutral"))


def band_signal(df: DataFrame, upper: str = "bb_upper", lower: str = "bb_lower") -> DataFrame:
    return last_row(df).withColumn("label", F.when(F.col("close") > F.col(upper), "Overbought").when(
        F.col("close") < F.col(lower), "Oversold").otherwise("Normal"))


def rsi_signal(df: DataFrame, col: str = "rsi_14") -> DataFrame:
    return last_row(df).withColumn("label", F.when(F.col(col) > 70, "Overbought").when(
        F.col(col) < 30, "Oversold").otherwise("Neutral"))


def macd_signal_label(df: DataFrame) -> DataFrame:
    h = F.col("macd_histogram")
    return last_row(df).withColumn("label", F.when(h > 0, "Bullish").when(h < 0, "Bearish").otherwise("Neutral"))


def momentum(df: DataFrame, n: int = 20) -> DataFrame:
    """Last price over the n-th price from the end, minus one; zero for short series."""
    value = F.coalesce(rate("close", n - 1), F.lit(0.0))
    return last_row(df.select("symbol", "date", value.alias("momentum")))


def price_change_card(df: DataFrame) -> DataFrame:
    w = series()
    first = F.first("close").over(w.rowsBetween(W.unboundedPreceding, 0))
    month = F.coalesce(prev("close", 20), first)
    df = df.select("symbol", "date", "close", "volume", (F.col("close") - prev("close")).alias("change"),
                   (rate("close") * 100).alias("pct_change"), ((F.try_divide(F.col("close"), month) - 1) * 100).alias("month_change"),
                   F.avg("volume").over(w.rowsBetween(-19, 0)).alias("avg_volume"))
    return last_row(df)
