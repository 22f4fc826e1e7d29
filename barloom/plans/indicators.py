"""Plans for the indicator operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.plans.oracle import W, ema, roll
from barloom.registry import query
from barloom.sources.tables import Tables

B = "bars"
RN = f"row_number() OVER ({W}) AS rn"


def pick(df, *cols):
    return df.select("symbol", "date", *cols)


TR = f"""greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0))"""
IDX = f", b AS (SELECT *, {RN} FROM bars)"
LINE = f"{IDX}, m AS (SELECT symbol, date, rn, {ema('close', 12)} - {ema('close', 26)} AS macd_line FROM b)"


@query("sma", f"SELECT symbol, date, {roll('avg', 'close', 20)} AS sma_20 FROM bars", B, r4="sma_20")
def _(t: Tables):
    return pick(ind.sma(t.bars, 20), "sma_20")


@query("ema", f"{IDX} SELECT symbol, date, {ema('close', 20)} AS ema_20 FROM b", B, r4="ema_20")
def _(t: Tables):
    return pick(ind.ema(t.bars, 20), "ema_20")


@query("ema_adjusted", f"""{IDX}
SELECT symbol, date, sum(close * pow(9.0 / 11, 1 - rn)) OVER ({W} ROWS UNBOUNDED PRECEDING)
  / sum(pow(9.0 / 11, 1 - rn)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ema_adj_10 FROM b""", B, r4="ema_adj_10")
def _(t: Tables):
    return pick(ind.ema_adjusted(t.bars, 10), "ema_adj_10")


@query("macd", f"""{LINE}, s AS (SELECT *, {ema('macd_line', 9)} AS macd_signal FROM m)
SELECT symbol, date, macd_line, macd_signal, macd_line - macd_signal AS macd_histogram FROM s""", B,
       r6="macd_line macd_signal macd_histogram")
def _(t: Tables):
    return pick(ind.macd(t.bars), "macd_line", "macd_signal", "macd_histogram")


RSI = f"""{{pre}}, d AS (SELECT *, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars),
g AS (SELECT *, {roll('avg', 'greatest(d, 0)', 14)} AS g, {roll('avg', 'greatest(-d, 0)', 14)} AS l FROM d)"""
RSI_V = "CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l = 0 THEN NULL ELSE 100 - 100 / (1 + g / l) END"


@query("rsi", RSI.format(pre="") + f" SELECT symbol, date, {RSI_V} AS rsi_14 FROM g", B, r4="rsi_14")
def _(t: Tables):
    return pick(ind.rsi(t.bars), "rsi_14")


BB = f""", s AS (SELECT *, {roll('avg', 'close', 20)} AS bb_middle, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)"""


@query("bollinger", BB + """ SELECT symbol, date, bb_middle + 2 * sd AS bb_upper, bb_middle, bb_middle - 2 * sd AS bb_lower,
  4 * sd / bb_middle AS bb_bandwidth, (close - (bb_middle - 2 * sd)) / nullif(4 * sd, 0) AS bb_percent_b FROM s""", B,
       r4="bb_upper bb_middle bb_lower", r6="bb_bandwidth bb_percent_b")
def _(t: Tables):
    return pick(ind.bollinger(t.bars), "bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", "bb_percent_b")


@query("stochastic", f""", s AS (SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars),
k AS (SELECT symbol, date, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k FROM s)
SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM k""", B, r4="stoch_k stoch_d")
def _(t: Tables):
    return pick(ind.stochastic(t.bars), "stoch_k", "stoch_d")


@query("true_range", f"SELECT symbol, date, {TR} AS tr FROM bars", B)
def _(t: Tables):
    return pick(t.bars, ind.true_range().alias("tr"))


TRB = f", r AS (SELECT *, {RN}, {TR} AS tr FROM bars)"


@query("atr_sma", f"{TRB} SELECT symbol, date, {roll('avg', 'tr', 14)} AS atr_14 FROM r", B, r4="atr_14")
def _(t: Tables):
    return pick(ind.atr_sma(t.bars), "atr_14")


@query("atr_ema", f"{TRB} SELECT symbol, date, {ema('tr', 14)} AS atr_14 FROM r", B, r4="atr_14")
def _(t: Tables):
    return pick(ind.atr_ema(t.bars), "atr_14")


def adx_sql(rival: str) -> str:
    return f"""{TRB}, m AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn FROM r),
p AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM m),
q AS (SELECT *, CASE WHEN dn > {rival} AND dn > 0 THEN dn ELSE 0 END AS ndm FROM p),
di AS (SELECT symbol, date, 100 * {roll('sum', 'pdm', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS pos_di,
  100 * {roll('sum', 'ndm', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS neg_di FROM q),
dx AS (SELECT *, 100 * abs(pos_di - neg_di) / nullif(pos_di + neg_di, 0) AS dx FROM di)
SELECT symbol, date, {roll('avg', 'dx', 14)} AS adx, pos_di, neg_di FROM dx"""


@query("adx", adx_sql("up"), B, r4="adx pos_di neg_di")
def _(t: Tables):
    return pick(ind.adx(t.bars), "adx", "pos_di", "neg_di")


@query("adx_raw_dm", adx_sql("pdm"), B, r4="adx pos_di neg_di")
def _(t: Tables):
    return pick(ind.adx(t.bars, raw_dm=True), "adx", "pos_di", "neg_di")


@query("obv", f""", s AS (SELECT symbol, date, coalesce(sign(close - lag(close) OVER ({W})), 0) * volume AS s FROM bars)
SELECT symbol, date, CAST(sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM s""", B)
def _(t: Tables):
    return pick(ind.obv(t.bars), "obv")


def mid(n: int) -> str:
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


@query("ichimoku", f""", m AS (SELECT *, {mid(9)} AS tenkan_sen, {mid(26)} AS kijun_sen, {mid(52)} AS sb FROM bars)
SELECT symbol, date, tenkan_sen, kijun_sen, lag((tenkan_sen + kijun_sen) / 2, 26) OVER ({W}) AS senkou_span_a,
  lag(sb, 26) OVER ({W}) AS senkou_span_b, lead(close, 26) OVER ({W}) AS chikou_span FROM m""", B)
def _(t: Tables):
    return pick(ind.ichimoku(t.bars), "tenkan_sen", "kijun_sen", "senkou_span_a", "senkou_span_b", "chikou_span")


@query("keltner", f"""{TRB}, k AS (SELECT symbol, date, {ema('close', 20)} AS keltner_middle, {ema('tr', 10)} AS a FROM r)
SELECT symbol, date, keltner_middle + 2 * a AS keltner_upper, keltner_middle, keltner_middle - 2 * a AS keltner_lower FROM k""",
       B, r4="keltner_upper keltner_middle keltner_lower")
def _(t: Tables):
    return pick(ind.keltner(t.bars), "keltner_upper", "keltner_middle", "keltner_lower")


VOL = (5, 10, 20, 30, 60)


@query("volatility_multi", f""", r AS (SELECT symbol, date, ln(close / lag(close) OVER ({W})) AS r FROM bars)
SELECT symbol, date, {', '.join(f"{roll('stddev_samp', 'r', n)} * sqrt(252) AS volatility_{n}" for n in VOL)} FROM r""", B,
       r6=" ".join(f"volatility_{n}" for n in VOL))
def _(t: Tables):
    return pick(ind.volatility_multi(t.bars), *[f"volatility_{n}" for n in VOL])


MA, EM = (20, 50, 100, 200), (12, 26, 50, 100)
NAMES = [(f"{k}_{n}") for k, ps in (("sma", MA), ("ema", EM)) for n in ps]
REL = [f"price_rel_{x}" for x in NAMES]
DIFF = [f"{k}_{a}_{b}_diff" for k, ps in (("sma", MA), ("ema", EM)) for a, b in zip(ps, ps[1:])]


@query("trend_mas", f"""{IDX}, m AS (SELECT symbol, date, close, {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in MA)},
  {', '.join(f"{ema('close', n)} AS ema_{n}" for n in EM)} FROM b)
SELECT symbol, date, {', '.join(NAMES)}, {', '.join(f'close / {x} - 1 AS price_rel_{x}' for x in NAMES)},
  {', '.join(f'{k}_{a} - {k}_{b} AS {k}_{a}_{b}_diff' for k, ps in (('sma', MA), ('ema', EM)) for a, b in zip(ps, ps[1:]))} FROM m""",
       B, r4=" ".join(NAMES + DIFF), r6=" ".join(REL))
def _(t: Tables):
    return pick(ind.trend_mas(t.bars), *NAMES, *REL, *DIFF)


ALL = """sma_20 sma_50 sma_200 ema_12 ema_26 macd_line macd_signal macd_histogram bb_upper bb_middle bb_lower rsi_14
stoch_k stoch_d atr_14 adx pos_di neg_di keltner_upper keltner_middle keltner_lower"""
EXACT = ["obv", "tenkan_sen", "kijun_sen", "senkou_span_a", "senkou_span_b", "chikou_span"]


IND = f"""{TRB},
x1 AS (SELECT symbol, date, rn, close, high, low, volume, tr, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50,
  {roll('avg', 'close', 200)} AS sma_200, {ema('close', 12)} AS ema_12, {ema('close', 26)} AS ema_26,
  {roll('stddev_samp', 'close', 20)} AS sd, coalesce(close - lag(close) OVER ({W}), 0) AS d,
  {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi, {ema('tr', 14)} AS atr_14, {ema('tr', 10)} AS a10,
  {ema('close', 20)} AS keltner_middle, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn,
  {mid(9)} AS tenkan_sen, {mid(26)} AS kijun_sen, {mid(52)} AS sb FROM r),
x2 AS (SELECT *, ema_12 - ema_26 AS macd_line, {roll('avg', 'greatest(d, 0)', 14)} AS g, {roll('avg', 'greatest(-d, 0)', 14)} AS l,
  100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS ndm FROM x1),
x3 AS (SELECT *, {ema('macd_line', 9)} AS macd_signal, {roll('avg', 'stoch_k', 3)} AS stoch_d,
  100 * {roll('sum', 'pdm', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS pos_di,
  100 * {roll('sum', 'ndm', 14)} / nullif({roll('sum', 'tr', 14)}, 0) AS neg_di FROM x2),
x4 AS (SELECT *, 100 * abs(pos_di - neg_di) / nullif(pos_di + neg_di, 0) AS dx FROM x3),
ind AS (SELECT symbol, date, rn, close, volume, sma_20, sma_50, sma_200, ema_12, ema_26, macd_line, macd_signal, macd_line - macd_signal AS macd_histogram,
  sma_20 + 2 * sd AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd AS bb_lower, {RSI_V} AS rsi_14, stoch_k, stoch_d, atr_14,
  {roll('avg', 'dx', 14)} AS adx, pos_di, neg_di, keltner_middle + 2 * a10 AS keltner_upper, keltner_middle,
  keltner_middle - 2 * a10 AS keltner_lower,
  CAST(sum(sign(d) * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv, tenkan_sen, kijun_sen,
  lag((tenkan_sen + kijun_sen) / 2, 26) OVER ({W}) AS senkou_span_a, lag(sb, 26) OVER ({W}) AS senkou_span_b,
  lead(close, 26) OVER ({W}) AS chikou_span FROM x4)"""


@query("all_indicators", f"{IND} SELECT * EXCLUDE (rn, close, volume) FROM ind", B, r4=ALL)
def _(t: Tables):
    return pick(ind.all_indicators(t.bars), *ALL.split(), *EXACT)
