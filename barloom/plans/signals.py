"""Plans for signals, anomalies and seasonal decomposition."""

from __future__ import annotations

from barloom.operators import anomalies, seasonal, signals
from barloom.operators import indicators as ind
from barloom.plans.indicators import BB, IDX, IND, LINE, RSI, RSI_V, TRB, adx_sql, pick
from barloom.plans.oracle import W, ema, roll
from barloom.registry import query
from barloom.sources.tables import Tables

B = "bars"
LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"


@query("market_regime", f""", a AS (SELECT symbol, date, close, {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200, 63, 126))},
  close / lag(close) OVER ({W}) - 1 AS ret, CASE WHEN row_number() OVER ({W}) > 1 THEN close / first(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 END AS cum FROM bars),
b AS (SELECT *, {roll('stddev_samp', 'ret', 63)} * sqrt(252) AS current_volatility, {roll('avg', 'cum', 63)} AS cumavg FROM a),
c AS (SELECT *, {roll('avg', 'current_volatility', 126)} AS historical_volatility,
  (coalesce(close > sma_200, false)::INT + coalesce(sma_50 > sma_200, false)::INT + coalesce(sma_20 > sma_50, false)::INT
   + coalesce(sma_63 > sma_126, false)::INT + coalesce(cumavg > 0, false)::INT) / 5.0::DOUBLE AS bullish_score FROM b {LAST})
SELECT symbol, date, bullish_score, current_volatility, historical_volatility,
  CASE WHEN bullish_score >= 0.7 THEN 'Bullish' WHEN bullish_score <= 0.3 THEN 'Bearish' ELSE 'Neutral' END AS regime,
  CASE WHEN current_volatility > historical_volatility * 1.5 THEN 'High' WHEN current_volatility < historical_volatility * 0.5 THEN 'Low' ELSE 'Normal' END AS volatility_regime,
  abs(bullish_score - 0.5) * 2 AS trend_strength FROM c""", B, r6="bullish_score current_volatility historical_volatility trend_strength")
def _(t: Tables):
    return signals.market_regime(t.bars)


@query("market_events", f""", a AS (SELECT symbol, date, close, {roll('avg', 'close', 50)} AS s, {roll('avg', 'close', 200)} AS l, close / lag(close) OVER ({W}) - 1 AS change FROM bars),
b AS (SELECT *, lag(s) OVER ({W}) AS ps, lag(l) OVER ({W}) AS pl FROM a)
SELECT symbol, date, 'Golden Cross' AS type, 'Bullish' AS significance, CAST(NULL AS DOUBLE) AS change FROM b WHERE s > l AND ps <= pl
UNION ALL SELECT symbol, date, 'Death Cross', 'Bearish', NULL FROM b WHERE s < l AND ps >= pl
UNION ALL SELECT symbol, date, 'Large Daily Move', 'High Volatility', change FROM b WHERE abs(change) >= 0.03""", B, r6="change")
def _(t: Tables):
    return signals.market_events(t.bars)


@query("trend_strength", f""", i AS (SELECT symbol, date, adx FROM ({adx_sql('up').replace(TRB, 'WITH ' + TRB[2:])})),
a AS (SELECT *, row_number() OVER ({W})::DOUBLE AS rn, CASE WHEN close > lag(close) OVER ({W}) THEN 1.0 ELSE 0.0 END AS up FROM bars),
b AS (SELECT symbol, date, regr_slope(close, rn) OVER ({W} ROWS 62 PRECEDING) AS sl, regr_r2(close, rn) OVER ({W} ROWS 62 PRECEDING) AS r_squared,
  first(close) OVER ({W} ROWS 62 PRECEDING) AS base, avg(up) OVER ({W} ROWS 62 PRECEDING) AS pos, count(*) OVER ({W} ROWS 62 PRECEDING) AS n FROM a {LAST}),
c AS (SELECT symbol, sl / base * 100 AS slope, r_squared, adx, greatest(pos, 1 - pos) AS directional_consistency FROM b JOIN i USING (symbol, date) WHERE n >= 63)
SELECT *, (slope / 10 + r_squared + adx / 100 + directional_consistency) / 4 AS trend_strength FROM c""", B,
       r6="slope r_squared directional_consistency trend_strength", r4="adx")
def _(t: Tables):
    return signals.trend_strength(t.bars)


@query("trend_class", f""", i AS (SELECT symbol, date, adx FROM ({adx_sql('pdm').replace(TRB, 'WITH ' + TRB[2:])})),
b AS (SELECT *, row_number() OVER ({W}) AS rn FROM bars),
a AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS s, {roll('avg', 'close', 50)} AS m, {roll('avg', 'close', 200)} AS g,
  {ema('close', 20)} AS ema_short, {ema('close', 50)} AS ema_medium, {ema('close', 200)} AS ema_long FROM b),
d AS (SELECT *, (g - lag(g, 20) OVER ({W})) / 20 AS slope, lag(s - m) OVER ({W}) AS px FROM a {LAST})
SELECT symbol, date, close, adx, slope AS trend_slope, s AS sma_short, m AS sma_medium, g AS sma_long, ema_short, ema_medium, ema_long,
  CASE WHEN (close > s AND s > m AND m > g) OR (close > s AND close > m AND close > g AND slope > 0) THEN 'uptrend'
       WHEN (close < s AND s < m AND m < g) OR (close < s AND close < m AND close < g AND slope < 0) THEN 'downtrend'
       WHEN slope > 0 THEN 'weak_uptrend' WHEN slope < 0 THEN 'weak_downtrend' ELSE 'sideways' END AS trend,
  abs(slope) * 200 / close AS trend_strength, close / s - 1 AS price_to_sma_short, close / m - 1 AS price_to_sma_medium, close / g - 1 AS price_to_sma_long,
  coalesce(s - m > 0 AND px <= 0, false) AS golden_cross, coalesce(s - m < 0 AND px >= 0, false) AS death_cross FROM d JOIN i USING (symbol, date)""", B,
       r4="adx sma_short sma_medium sma_long ema_short ema_medium ema_long",
       r6="trend_slope trend_strength price_to_sma_short price_to_sma_medium price_to_sma_long")
def _(t: Tables):
    return signals.trend_class(t.bars)


@query("trend_direction", f""", i AS (SELECT symbol, date, adx FROM ({adx_sql('up').replace(TRB, 'WITH ' + TRB[2:])})),
a AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS ma_20, {roll('avg', 'close', 50)} AS ma_50, {roll('avg', 'close', 200)} AS ma_200 FROM bars {LAST}),
b AS (SELECT *, CASE WHEN ma_20 > ma_200 THEN 'Bullish' WHEN ma_20 < ma_200 THEN 'Bearish' ELSE 'Neutral' END AS trend_direction,
  CASE WHEN ma_20 > ma_200 THEN ma_20 / ma_200 - 1 WHEN ma_20 < ma_200 THEN 1 - ma_20 / ma_200 ELSE 0 END AS s FROM a JOIN i USING (symbol, date))
SELECT symbol, date, close, adx, ma_20, ma_50, ma_200, trend_direction,
  CASE WHEN adx IS NULL THEN s WHEN adx < 20 THEN least(s, 0.2) WHEN adx < 30 THEN greatest(s, 0.5) WHEN adx < 50 THEN greatest(s, 0.8) ELSE greatest(s, 1.0) END AS trend_strength,
  coalesce(close / ma_20 - 1, 0) AS vs_ma_20, coalesce(close / ma_50 - 1, 0) AS vs_ma_50, coalesce(close / ma_200 - 1, 0) AS vs_ma_200 FROM b""", B,
       r4="adx ma_20 ma_50 ma_200", r6="trend_strength vs_ma_20 vs_ma_50 vs_ma_200")
def _(t: Tables):
    return signals.trend_direction(t.bars)


def above(a: str, b: str) -> str:
    return f"coalesce(round({a} - {b}, 9) > 0 AND lag(round({a} - {b}, 9)) OVER ({W}) <= 0, false)"


def below(a: str, b: str) -> str:
    return f"coalesce(round({a} - {b}, 9) < 0 AND lag(round({a} - {b}, 9)) OVER ({W}) >= 0, false)"


SIG = f"""{IND}, sg AS (SELECT symbol, date, close AS price, {above('sma_50', 'sma_200')} AS golden_cross, {below('sma_50', 'sma_200')} AS death_cross,
  {above('macd_line', 'macd_signal')} AS macd_bullish_cross, {below('macd_line', 'macd_signal')} AS macd_bearish_cross,
  {above('rsi_14', '30')} AS rsi_oversold, {below('rsi_14', '70')} AS rsi_overbought, {above('close', 'bb_upper')} AS bb_upper_breakout,
  {below('close', 'bb_lower')} AS bb_lower_breakdown, {above('stoch_k', 'stoch_d')} AND stoch_k < 50 AS stoch_bullish_cross,
  {below('stoch_k', 'stoch_d')} AND stoch_k > 50 AS stoch_bearish_cross, {above('adx', '25')} AS adx_strong_trend,
  coalesce(volume > 2 * {roll('avg', 'volume', 20)}, false) AS volume_spike FROM ind),
sh AS (SELECT *, macd_bullish_cross OR rsi_oversold OR stoch_bullish_cross AS buy_signal, macd_bearish_cross OR rsi_overbought OR stoch_bearish_cross AS sell_signal,
  macd_bullish_cross::INT + rsi_oversold::INT + stoch_bullish_cross::INT + golden_cross::INT + bb_lower_breakdown::INT AS buy_count,
  macd_bearish_cross::INT + rsi_overbought::INT + stoch_bearish_cross::INT + death_cross::INT + bb_upper_breakout::INT AS sell_count FROM sg),
sigs AS (SELECT *, buy_count >= 2 AS strong_buy, sell_count >= 2 AS strong_sell FROM sh)"""


@query("trading_signals", f"{SIG} SELECT * FROM sigs", B)
def _(t: Tables):
    return signals.trading_signals(t.bars)


KINDS = signals.BUY + signals.SELL + ["strong_buy", "strong_sell"]


@query("signal_effectiveness", f"""{SIG}, fr AS (SELECT *, (coalesce(lead(price, 20) OVER ({W}), last(price) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / price - 1) * 100 AS r FROM sigs),
u AS ({' UNION ALL '.join(f"SELECT '{k}' AS signal, r, {'r > 0' if k in signals.BUY + ['strong_buy'] else 'r < 0'} AS win FROM fr WHERE {k}" for k in KINDS)})
SELECT signal, count(*) AS count, avg(r) AS avg_return, max(r) AS max_return, min(r) AS min_return, avg(win::INT) * 100 AS win_rate FROM u GROUP BY signal""",
       B, r6="avg_return max_return min_return win_rate")
def _(t: Tables):
    return signals.signal_effectiveness(signals.trading_signals(t.bars))


@query("ma_signal", f""", a AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50 FROM bars {LAST})
SELECT *, CASE WHEN close > sma_50 AND sma_20 > sma_50 THEN 'Bullish' WHEN close < sma_50 AND sma_20 < sma_50 THEN 'Bearish' ELSE 'Neutral' END AS label FROM a""", B, r4="sma_20 sma_50")
def _(t: Tables):
    return signals.ma_signal(t.bars)


@query("bollinger_signal", f"""{BB}, l AS (SELECT symbol, date, close, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower FROM s {LAST})
SELECT *, CASE WHEN close > bb_upper THEN 'Overbought' WHEN close < bb_lower THEN 'Oversold' ELSE 'Normal' END AS label FROM l""", B, r4="bb_upper bb_lower")
def _(t: Tables):
    return signals.band_signal(ind.bollinger(t.bars).select("symbol", "date", "close", "bb_upper", "bb_lower"))


@query("rsi_signal", RSI.format(pre="") + f""", l AS (SELECT symbol, date, {RSI_V} AS rsi_14 FROM g {LAST})
SELECT *, CASE WHEN rsi_14 > 70 THEN 'Overbought' WHEN rsi_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS label FROM l""", B, r4="rsi_14")
def _(t: Tables):
    return signals.rsi_signal(pick(ind.rsi(t.bars), "rsi_14"))


@query("macd_signal_label", f"""{LINE}, s AS (SELECT *, {ema('macd_line', 9)} AS macd_signal FROM m),
l AS (SELECT symbol, date, macd_line, macd_signal, macd_line - macd_signal AS macd_histogram FROM s {LAST})
SELECT *, CASE WHEN macd_histogram > 0 THEN 'Bullish' WHEN macd_histogram < 0 THEN 'Bearish' ELSE 'Neutral' END AS label FROM l""", B,
       r6="macd_line macd_signal macd_histogram")
def _(t: Tables):
    return signals.macd_signal_label(pick(ind.macd(t.bars), "macd_line", "macd_signal", "macd_histogram"))


@query("momentum", f"SELECT symbol, date, coalesce(close / lag(close, 19) OVER ({W}) - 1, 0) AS momentum FROM bars {LAST}", B, r6="momentum")
def _(t: Tables):
    return signals.momentum(t.bars)


@query("price_change_card", f"""SELECT symbol, date, close, volume, close - lag(close) OVER ({W}) AS change, (close / lag(close) OVER ({W}) - 1) * 100 AS pct_change,
  (close / coalesce(lag(close, 20) OVER ({W}), first(close) OVER ({W} ROWS UNBOUNDED PRECEDING)) - 1) * 100 AS month_change,
  avg(volume) OVER ({W} ROWS 19 PRECEDING) AS avg_volume FROM bars {LAST}""", B, r6="change pct_change month_change avg_volume")
def _(t: Tables):
    return signals.price_change_card(t.bars)


@query("zscore_anomaly", f""", z AS (SELECT symbol, date, close, (close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS z,
  (close - avg(close) OVER (PARTITION BY symbol)) / stddev_samp(close) OVER (PARTITION BY symbol) AS zg FROM bars)
SELECT symbol, date, close, coalesce(abs(z) > 2.5, false)::INT AS rolling_flag, coalesce(abs(zg) > 2.5, false)::INT AS series_flag FROM z""", B)
def _(t: Tables):
    df = anomalies.zscore(t.bars, threshold=2.5, out="rolling_flag")
    return pick(anomalies.zscore(df, threshold=2.5, n=None, out="series_flag"), "close", "rolling_flag", "series_flag")


Q = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
IQR = f""", q AS (SELECT symbol, date, close, quantile_cont(close, 0.25) {Q} AS q1, quantile_cont(close, 0.75) {Q} AS q3, count(*) {Q} AS n FROM bars),
fl AS (SELECT symbol, date, close, (n = 20 AND (close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1)))::INT AS is_anomaly FROM q)"""


@query("iqr_anomaly", f"{IQR} SELECT * FROM fl", B)
def _(t: Tables):
    return pick(anomalies.iqr(t.bars), "close", "is_anomaly")


MAA = f"SELECT symbol, date, close, coalesce(close > m + 2.5 * s OR close < m - 2.5 * s, false)::INT AS is_anomaly FROM (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)"


@query("ma_anomaly", MAA, B)
def _(t: Tables):
    return pick(anomalies.moving_average(t.bars, threshold=2.5), "close", "is_anomaly")


@query("outlier_values", f"{IQR} SELECT symbol, date, is_anomaly AS is_outlier, CASE WHEN is_anomaly = 1 THEN close END AS outlier_value FROM fl", B)
def _(t: Tables):
    return pick(anomalies.outlier_values(t.bars, method="iqr", factor=1.5), "is_outlier", "outlier_value")


@query("lof_anomaly", """, k AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY close, date) AS p FROM bars),
nb AS (SELECT a.symbol, a.date, b.date AS nd, abs(a.close - b.close) AS d, row_number() OVER (PARTITION BY a.symbol, a.date ORDER BY abs(a.close - b.close), b.date) AS r
  FROM k a JOIN k b ON a.symbol = b.symbol AND b.p BETWEEN a.p - 20 AND a.p + 20 AND a.date <> b.date),
n20 AS (SELECT * FROM nb WHERE r <= 20),
kd AS (SELECT symbol, date, max(d) AS kd FROM n20 GROUP BY 1, 2),
lrd AS (SELECT n.symbol, n.date, 1 / (avg(greatest(n.d, kd.kd)) + 1e-10) AS lrd FROM n20 n JOIN kd ON kd.symbol = n.symbol AND kd.date = n.nd GROUP BY 1, 2),
lf AS (SELECT n.symbol, n.date, avg(b.lrd) / any_value(a.lrd) AS lof FROM n20 n JOIN lrd a ON a.symbol = n.symbol AND a.date = n.date
  JOIN lrd b ON b.symbol = n.symbol AND b.date = n.nd GROUP BY 1, 2)
SELECT symbol, date, lof, (lof > quantile_cont(lof, 0.95) OVER (PARTITION BY symbol))::INT AS is_anomaly FROM lf""", B, r4="lof")
def _(t: Tables):
    return pick(anomalies.lof(t.bars.select("symbol", "date", "close")), "lof", "is_anomaly")


DEC = f""", a AS (SELECT symbol, date, close, (row_number() OVER ({W}) - 1) % 12 AS ph, CASE WHEN count(*) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
  THEN (sum(close) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(close, 6) OVER ({W}) + lead(close, 6) OVER ({W})) / 2) / 12 END AS trend FROM bars),
m AS (SELECT symbol, ph, avg(close - trend) AS m FROM a GROUP BY 1, 2), ce AS (SELECT symbol, avg(m) AS c FROM m GROUP BY 1),
dec AS (SELECT symbol, date, close, trend, m - c AS seasonal, close - trend - (m - c) AS residual FROM a JOIN m USING (symbol, ph) JOIN ce USING (symbol))"""


@query("seasonal_decompose", f"{DEC} SELECT symbol, date, trend, seasonal, residual FROM dec", B, r4="trend", r6="seasonal residual")
def _(t: Tables):
    return pick(seasonal.decompose(t.bars), "trend", "seasonal", "residual")


@query("seasonal_strength", f"{DEC} SELECT symbol, coalesce(avg(abs(seasonal)) / nullif(avg(abs(residual)), 0), 0) AS seasonality_strength FROM dec GROUP BY symbol", B, r6="seasonality_strength")
def _(t: Tables):
    return seasonal.strength(seasonal.decompose(t.bars))


@query("seasonal_pattern", f"{DEC} SELECT symbol, CAST(month(date) AS INTEGER) AS unit, avg(seasonal) AS pattern FROM dec GROUP BY 1, 2", B, r6="pattern")
def _(t: Tables):
    return seasonal.pattern(seasonal.decompose(t.bars))
