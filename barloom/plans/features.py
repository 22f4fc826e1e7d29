"""Plans for model features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.plans.indicators import IDX, pick
from barloom.plans.oracle import W, roll
from barloom.registry import query
from barloom.sources.tables import Tables

B = "bars"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


DP = """weekday(date) AS wd"""
PARTS = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(week(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(year(date) AS INTEGER) AS year, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
  CAST(date = last_day(date) AS INTEGER) AS is_month_end, CAST(date = date_trunc('quarter', date) AS INTEGER) AS is_quarter_start,
  CAST(date = date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS INTEGER) AS is_quarter_end"""
PART_NAMES = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_month_start", "is_month_end",
              "is_quarter_start", "is_quarter_end"]


@query("date_parts", f"SELECT symbol, date, {PARTS} FROM bars", B)
def _(t: Tables):
    return pick(ft.date_parts(t.bars), *PART_NAMES)


@query("date_parts_ext", f"""SELECT symbol, date, {PARTS}, CAST(dayofyear(date) = 1 AS INTEGER) AS is_year_start,
  CAST(month(date) = 12 AND day(date) = 31 AS INTEGER) AS is_year_end, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
  sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos FROM bars""", B, r6="month_sin month_cos")
def _(t: Tables):
    return pick(ft.date_parts(t.bars, extended=True), *PART_NAMES, "is_year_start", "is_year_end", "is_weekend", "month_sin", "month_cos")


LAGS = (1, 2, 3, 5, 10)


@query("lag_features", f"SELECT symbol, date, {', '.join(f'{lag(c, k)} AS {c}_lag_{k}' for c in ('close', 'volume') for k in LAGS)} FROM bars", B)
def _(t: Tables):
    return ft.lag_features(t.bars, ["close", "volume"], LAGS).drop("open", "high", "low", "close", "volume")


AGG = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}


def rolled(c: str, n: int, prefix: str = "") -> str:
    return ", ".join(f"{roll(fn, c, n)} AS {c}_{name}_{n}" for name, fn in AGG.items())


RF = [(c, n) for c in ("close",) for n in (5, 10, 21, 63)]


@query("rolling_features", f"SELECT symbol, date, {', '.join(rolled(c, n) for c, n in RF)} FROM bars", B,
       r4=" ".join(f"close_{x}_{n}" for _, n in RF for x in ("mean", "std")))
def _(t: Tables):
    return ft.rolling_features(t.bars.select("symbol", "date", "close"), ["close"], (5, 10, 21, 63)).drop("close")


@query("rolling_mean_std", f"""SELECT symbol, date, {', '.join(f"{roll('avg', 'close', n)} AS close_rolling_mean_{n}, {roll('stddev_samp', 'close', n)} AS close_rolling_std_{n}" for n in (7, 30))} FROM bars""",
       B, r4="close_rolling_mean_7 close_rolling_std_7 close_rolling_mean_30 close_rolling_std_30")
def _(t: Tables):
    return ft.rolling_mean_std(t.bars, "close", (7, 30)).drop("open", "high", "low", "close", "volume")


PER = (1, 5, 10, 21, 63)
RETS = ", ".join(f"close / {lag('close', k)} - 1 AS return_{k}d, ln(close / {lag('close', k)}) AS log_return_{k}d" for k in PER)
RET_NAMES = " ".join(f"return_{k}d log_return_{k}d" for k in PER)


@query("return_features", f"SELECT symbol, date, {RETS} FROM bars", B, r6=RET_NAMES)
def _(t: Tables):
    return pick(ft.return_features(t.bars, "close", PER), *RET_NAMES.split())


AFR = [(c, n) for c in ("close", "volume") for n in (5, 10, 21, 63)]


@query("all_features", f"""SELECT symbol, date, close, volume, {PARTS},
  {', '.join(f'{lag(c, k)} AS {c}_lag_{k}' for c in ('close', 'volume') for k in LAGS)}, {', '.join(rolled(c, n) for c, n in AFR)}, {RETS} FROM bars""", B,
       r4=" ".join(f"{c}_{x}_{n}" for c, n in AFR for x in ("mean", "std")), r6=RET_NAMES)
def _(t: Tables):
    return ft.all_features(t.bars.drop("open", "high", "low"))


SHAPE = "pct_change log_return high_low_range_pct open_close_range_pct volume_change volume_relative"


@query("price_shape", f"""SELECT symbol, date, close - {lag('close')} AS price_change, close / {lag('close')} - 1 AS pct_change,
  ln(close / {lag('close')}) AS log_return, high - low AS high_low_range, (high - low) / close AS high_low_range_pct,
  close - open AS open_close_range, (close - open) / open AS open_close_range_pct, high - greatest(open, close) AS upper_shadow,
  least(open, close) - low AS lower_shadow, abs(close - open) AS body_size, volume / {lag('volume')} - 1 AS volume_change,
  volume / {roll('avg', 'volume', 20)} AS volume_relative FROM bars""", B, r6=SHAPE)
def _(t: Tables):
    return ft.price_shape(t.bars).drop("open", "high", "low", "close", "volume")


H = (1, 5, 10)


@query("target_variables", f"""SELECT symbol, date, {', '.join(f"lead(close, {k}) OVER ({W}) AS future_price_{k}d, lead(close, {k}) OVER ({W}) / close - 1 AS target_{k}d_return, CAST(lead(close, {k}) OVER ({W}) > close AS INTEGER) AS target_{k}d_direction" for k in H)} FROM bars""",
       B, r6=" ".join(f"target_{k}d_return" for k in H))
def _(t: Tables):
    return ft.target_variables(t.bars, H).drop("open", "high", "low", "close", "volume")


LAGS10 = ", ".join(f"{lag('close', k)} AS close_lag_{k}" for k in range(1, 11))
SAMPLE = ", ".join(f"{roll(fn, 'close', 10)} AS close_rolling_{n}_10" for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("model_features_a", f""", m AS (SELECT symbol, date, close, {LAGS10}, {SAMPLE}, close / {lag('close')} - 1 AS close_pct_change,
  abs(close / {lag('close')} - 1) AS close_pct_change_abs, lead(close) OVER ({W}) AS close_target_1 FROM bars)
SELECT * FROM m WHERE close_lag_10 IS NOT NULL AND close_target_1 IS NOT NULL""", B,
       r4="close_rolling_mean_10 close_rolling_std_10", r6="close_pct_change close_pct_change_abs")
def _(t: Tables):
    return ft.model_features_a(t.bars.select("symbol", "date", "close"))


@query("model_features_b", f"""{IDX}, m AS (SELECT symbol, date, close, {LAGS10}, {SAMPLE},
  CASE WHEN rn >= 10 THEN median(close) OVER ({W} ROWS 9 PRECEDING) END AS close_rolling_median_10,
  sum(close * pow(9.0 / 11, 1 - rn)) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(pow(9.0 / 11, 1 - rn)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS close_ema_10,
  (close / {lag('close', 10)} - 1) * 100 AS close_roc_10, close / {lag('close')} - 1 AS close_pct_change_1,
  close / {lag('close', 5)} - 1 AS close_pct_change_5, abs(close - {lag('close')}) AS close_abs_change,
  lead(close) OVER ({W}) AS close_target_1, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day_of_month, CAST(quarter(date) AS INTEGER) AS quarter FROM b),
n AS (SELECT *, close_pct_change_1 / nullif({lag('close_pct_change_1')}, 0) - 1 AS close_acceleration FROM m)
SELECT * FROM n WHERE close_lag_10 IS NOT NULL AND close_target_1 IS NOT NULL AND close_acceleration IS NOT NULL""", B,
       r4="close_rolling_mean_10 close_rolling_std_10 close_rolling_median_10 close_ema_10 close_roc_10 close_acceleration",
       r6="close_pct_change_1 close_pct_change_5")
def _(t: Tables):
    return ft.model_features_b(t.bars.select("symbol", "date", "close"))


@query("sequences", f""", s AS (SELECT symbol, date, list(close) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS window, close AS label FROM bars)
SELECT symbol, date, "window", label FROM s WHERE len("window") = 10""", B)
def _(t: Tables):
    return pick(ft.sequences(t.bars, ["close"], 10), "window", "label")


R = "returns"


@query("rolling_sharpe", f"SELECT symbol, date, coalesce({roll('avg', 'ret', 12)} / nullif({roll('stddev_samp', 'ret', 12)}, 0), 0) AS rolling_sharpe FROM returns", R, r6="rolling_sharpe")
def _(t: Tables):
    return pick(ft.rolling_sharpe(t.returns), "rolling_sharpe")


@query("rolling_stats", f""", s AS (SELECT symbol, date, {roll('avg', 'ret', 252)} * 252 AS rolling_return, {roll('stddev_samp', 'ret', 252)} * sqrt(252) AS rolling_volatility FROM returns)
SELECT *, rolling_return / nullif(rolling_volatility, 0) AS rolling_sharpe FROM s""", R, r6="rolling_return rolling_volatility rolling_sharpe")
def _(t: Tables):
    return pick(ft.rolling_stats(t.returns), "rolling_return", "rolling_volatility", "rolling_sharpe")


@query("rolling_metrics", f""", f AS (SELECT symbol, date, {roll('avg', 'ret', 60)} * 252 AS returns, {roll('stddev_samp', 'ret', 60)} * sqrt(252) AS volatility,
  CASE WHEN count(ret) OVER ({W} ROWS 59 PRECEDING) >= 60 THEN stddev_samp(CASE WHEN ret < 0 THEN ret END) OVER ({W} ROWS 59 PRECEDING) END * sqrt(252) AS downside_risk,
  list(ret) OVER ({W} ROWS 59 PRECEDING) AS fr FROM portfolio_series),
g AS (SELECT symbol, date, p, v FROM (SELECT symbol, date, unnest(fr) AS r, generate_subscripts(fr, 1) AS p FROM f WHERE len(fr) = 60),
  LATERAL (SELECT r AS v)),
h AS (SELECT symbol, date, p, exp(sum(ln(1 + v)) OVER (PARTITION BY symbol, date ORDER BY p)) AS c FROM g),
k AS (SELECT symbol, date, c / max(c) OVER (PARTITION BY symbol, date ORDER BY p) - 1 AS dd FROM h),
d AS (SELECT symbol, date, min(dd) AS max_drawdown FROM k GROUP BY 1, 2)
SELECT f.symbol AS portfolio_id, f.date, returns, volatility, downside_risk, returns / nullif(volatility, 0) AS sharpe_ratio,
  returns / nullif(downside_risk, 0) AS sortino_ratio, max_drawdown FROM f LEFT JOIN d USING (symbol, date)""", "portfolio_series",
       r6="returns volatility downside_risk sharpe_ratio sortino_ratio max_drawdown")
def _(t: Tables):
    out = ft.rolling_metrics(t.portfolio_series).withColumnRenamed("symbol", "portfolio_id")
    return out.drop("ret")


@query("drawdown_series", f"""SELECT symbol, date, close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
  close / first(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS cumulative_return FROM bars""", B, r6="drawdown cumulative_return")
def _(t: Tables):
    return pick(ft.drawdown_series(t.bars), "drawdown", "cumulative_return")


@query("simple_return", f"SELECT symbol, date, close / {lag('close')} - 1 AS ret FROM bars", B, r6="ret")
def _(t: Tables):
    return ft.return_features(t.bars, "close", (1,), log_returns=False).select("symbol", "date", F.col("return_1d").alias("ret"))


@query("log_return", f"SELECT symbol, date, ln(close / {lag('close')}) AS ret FROM bars", B, r6="ret")
def _(t: Tables):
    return ft.return_features(t.bars, "close", (1,)).select("symbol", "date", F.col("log_return_1d").alias("ret"))


@query("custom_feature_hook", f""", a AS (SELECT symbol, date, (high + low + close) / 3 AS typical, close FROM bars)
SELECT symbol, date, typical, close / typical - 1 AS close_to_typical FROM a""", B, r4="typical", r6="close_to_typical")
def _(t: Tables):
    def typical(df):
        return df.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)

    def relative(df):
        return df.withColumn("close_to_typical", F.col("close") / F.col("typical") - 1)

    df = t.bars
    for step in (typical, relative):
        df = df.transform(step)
    return pick(df, "typical", "close_to_typical")


@query("custom_rolling_hook", f"""SELECT symbol, date, {roll('max', 'close', 10)} - {roll('min', 'close', 10)} AS close_range_10,
  sqrt({roll('avg', 'close * close', 10)}) AS close_rms_10 FROM bars""", B, r4="close_range_10 close_rms_10")
def _(t: Tables):
    df = t.bars.select("symbol", "date", "close")
    df = ft.rolling_python(df, "close", 10, "range", np.ptp)
    df = ft.rolling_python(df, "close", 10, "rms", lambda a: float(np.sqrt(np.mean(a * a))))
    return df.drop("close")
