"""Plans for return, volatility, drawdown and tail statistics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.operators import statistics as s
from barloom.plans.oracle import W, roll
from barloom.registry import query
from barloom.sources.tables import Tables

RP = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"
SK = "(skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0)))"
KU = "kurtosis_pop({x})"


def skew(x: str) -> str:
    return SK.format(x=x)


def kurt(x: str) -> str:
    return KU.format(x=x)


def dd_cte(src: str) -> str:
    return f"""dc AS (SELECT symbol, date, ret, exp(sum(ln(1 + ret)) {RP}) AS curve FROM {src}),
dd AS (SELECT *, curve / max(curve) {RP} - 1 AS drawdown FROM dc)"""


for unit in ("week", "month", "quarter", "year"):
    name = "resample_last" if unit == "month" else f"resample_last_{unit}"

    @query(name, f""", p AS (SELECT symbol, CAST(date_trunc('{unit}', date) AS DATE) AS period, arg_max(close, date) AS last FROM bars GROUP BY 1, 2)
SELECT *, last / lag(last) OVER (PARTITION BY symbol ORDER BY period) - 1 AS ret FROM p""", "bars", r6="ret")
    def _(t: Tables, unit=unit):
        return s.resample_last(t.bars, unit)


@query("resample_returns", """SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS period, exp(sum(ln(1 + ret))) - 1 AS compound, sum(ret) AS total
FROM returns GROUP BY 1, 2""", "returns", r6="compound total")
def _(t: Tables):
    a = s.resample_returns(t.returns).withColumnRenamed("ret", "compound")
    return a.join(s.resample_returns(t.returns, method="sum").withColumnRenamed("ret", "total"), ["symbol", "period"])


def cal(unit: str, label: str) -> str:
    return f"""SELECT symbol, '{unit}_return' AS kind, {label} AS label, ret AS value FROM (
  SELECT symbol, p, l / lag(l) OVER (PARTITION BY symbol ORDER BY p) - 1 AS ret FROM (
    SELECT symbol, date_trunc('{unit}', date) AS p, arg_max(close, date) AS l FROM bars GROUP BY 1, 2)) WHERE ret IS NOT NULL"""


@query("performance_calendar", f"""{cal('quarter', "'Q' || quarter(p) || ' ' || year(p)")} UNION ALL {cal('year', "CAST(year(p) AS VARCHAR)")}
UNION ALL SELECT symbol, 'month_cumulative', strftime(p, '%Y-%m'), l / first(f) OVER (PARTITION BY symbol ORDER BY p) - 1 FROM (
  SELECT symbol, date_trunc('month', date) AS p, arg_max(close, date) AS l, arg_min(close, date) AS f FROM bars GROUP BY 1, 2)""", "bars", r6="value")
def _(t: Tables):
    return s.performance_calendar(t.bars)


@query("analyze_returns", f""", r AS (SELECT symbol, date, close, close / lag(close) OVER ({W}) - 1 AS ret FROM bars),
p AS (SELECT *, max(CASE WHEN ret IS NOT NULL THEN close END) {RP} AS pk FROM r),
a AS (SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS total_return, avg(ret) AS daily_mean, stddev_samp(ret) AS daily_std,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) AS ds, min(close / pk - 1) AS max_drawdown, count_if(ret > 0) AS positive_days,
  count_if(ret < 0) AS negative_days, count(ret) AS num_observations FROM p GROUP BY symbol)
SELECT symbol, total_return, pow(1 + total_return, 252.0 / num_observations) - 1 AS annualized_return, daily_mean, daily_std,
  daily_mean / daily_std * sqrt(252) AS sharpe_ratio, daily_mean / ds * sqrt(252) AS sortino_ratio, max_drawdown,
  CAST(positive_days AS BIGINT) AS positive_days, CAST(negative_days AS BIGINT) AS negative_days, positive_days / num_observations AS win_rate, num_observations FROM a""", "bars",
       r6="total_return annualized_return daily_mean daily_std sharpe_ratio sortino_ratio max_drawdown win_rate")
def _(t: Tables):
    return s.analyze_returns(t.bars)


@query("analyze_volatility", f""", r AS (SELECT symbol, date, close / lag(close) OVER ({W}) - 1 AS ret FROM bars),
v AS (SELECT *, {roll('stddev_samp', 'ret', 21)} * sqrt(252) AS rv FROM r), w AS (SELECT *, rv / lag(rv) OVER ({W}) - 1 AS vv FROM v)
SELECT symbol, stddev_samp(ret) AS daily_volatility, stddev_samp(ret) * sqrt(252) AS annualized_volatility, arg_max(rv, date) AS current_volatility,
  {', '.join(f'quantile_cont(rv, {q}) AS volatility_{int(q * 100)}th' for q in (0.25, 0.5, 0.75, 0.9))}, stddev_samp(vv) * sqrt(252) AS volatility_of_volatility FROM w GROUP BY symbol""",
       "bars", r6="daily_volatility annualized_volatility current_volatility volatility_25th volatility_50th volatility_75th volatility_90th volatility_of_volatility")
def _(t: Tables):
    return s.analyze_volatility(t.bars)


@query("sharpe", "SELECT symbol, (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe FROM returns GROUP BY symbol", "returns", r6="sharpe")
def _(t: Tables):
    return t.returns.groupBy("symbol").agg(st.sharpe("ret", 0.02).alias("sharpe"))


@query("sharpe_period", """SELECT symbol, (avg(ret) - 0.001) / stddev_samp(ret) * sqrt(12) AS sharpe FROM (
  SELECT symbol, date_trunc('month', date) AS p, exp(sum(ln(1 + ret))) - 1 AS ret FROM returns GROUP BY 1, 2) GROUP BY symbol""", "returns", r6="sharpe")
def _(t: Tables):
    monthly = s.resample_returns(t.returns)
    return monthly.groupBy("symbol").agg(st.sharpe("ret", 0.001 * 12, st.PERIODS["monthly"]).alias("sharpe"))


@query("sortino", "SELECT symbol, (avg(ret) - 0.02 / 252) / stddev_samp(CASE WHEN ret < 0.02 / 252 THEN ret END) * sqrt(252) AS sortino FROM returns GROUP BY symbol", "returns", r6="sortino")
def _(t: Tables):
    return t.returns.groupBy("symbol").agg(st.sortino("ret", 0.02).alias("sortino"))


@query("sortino_target", "SELECT symbol, avg(ret) / sqrt(avg(CASE WHEN ret < 0.001 THEN ret * ret END)) * sqrt(252) AS sortino FROM returns GROUP BY symbol", "returns", r6="sortino")
def _(t: Tables):
    return t.returns.groupBy("symbol").agg(st.sortino_target("ret", target=0.001).alias("sortino"))


@query("max_drawdown", f", {dd_cte('returns')} SELECT symbol, -min(drawdown) AS max_drawdown FROM dd GROUP BY symbol", "returns", r6="max_drawdown")
def _(t: Tables):
    return s.max_drawdown(t.bars)


MDD = """w AS (SELECT *, min(drawdown) OVER (PARTITION BY symbol) AS worst, max(date) OVER (PARTITION BY symbol) AS last FROM dd),
e AS (SELECT symbol, min(date) AS e FROM w WHERE drawdown = worst GROUP BY symbol),
tp AS (SELECT w.symbol, max(curve) AS top FROM w JOIN e USING (symbol) WHERE date <= e GROUP BY 1),
md AS (SELECT w.symbol, -min(worst) AS max_drawdown, min(CASE WHEN curve = top AND date <= e THEN date END) AS drawdown_start, min(e) AS drawdown_end,
  min(CASE WHEN date >= e AND curve >= top THEN date END) AS drawdown_recovery, min(last) AS last FROM w JOIN e USING (symbol) JOIN tp USING (symbol) GROUP BY 1),
mdd AS (SELECT symbol, max_drawdown, drawdown_start, drawdown_end, drawdown_recovery,
  CAST(coalesce(drawdown_recovery, last) - drawdown_start AS INTEGER) AS drawdown_duration, drawdown_recovery IS NOT NULL AS recovered FROM md)"""


@query("max_drawdown_dates", f", {dd_cte('returns')}, {MDD} SELECT * FROM mdd", "returns", r6="max_drawdown")
def _(t: Tables):
    return s.max_drawdown_dates(t.returns)


@query("drawdown_profile", f""", {dd_cte('returns')}, i AS (SELECT *, row_number() OVER ({W}) AS i, sum((drawdown < 0)::INT) {RP} AS c, count(*) OVER (PARTITION BY symbol) AS n FROM dd),
g AS (SELECT symbol, i - c AS isl, count(*) AS len, max(i) = max(n) AS open FROM i WHERE drawdown < 0 GROUP BY 1, 2),
p AS (SELECT symbol, avg(len) AS avg_duration, avg(CASE WHEN NOT open THEN len END) AS avg_recovery FROM g GROUP BY 1),
d AS (SELECT symbol, min(drawdown) * 100 AS max_drawdown, coalesce(avg(CASE WHEN drawdown < 0 THEN drawdown * 100 END), 0) AS avg_drawdown FROM dd GROUP BY 1)
SELECT symbol, max_drawdown, avg_drawdown, coalesce(avg_duration, 0) AS avg_duration, coalesce(avg_recovery, 0) AS avg_recovery,
  coalesce(coalesce(avg_recovery, 0) / nullif(avg_duration, 0), 0) AS recovery_ratio FROM d LEFT JOIN p USING (symbol)""", "returns",
       r6="max_drawdown avg_drawdown avg_duration avg_recovery recovery_ratio")
def _(t: Tables):
    return s.drawdown_profile(t.returns)


@query("align_inner_benchmark", """SELECT r.symbol, r.date, r.ret, b.ret AS bench FROM returns r JOIN benchmark_returns b USING (date)
QUALIFY count(*) OVER (PARTITION BY r.symbol) >= 30""", "benchmark_returns", r6="ret bench")
def _(t: Tables):
    return s.with_benchmark(t.returns, t.benchmark, 30)


@query("beta", """, p AS (SELECT r.symbol, r.ret, b.ret AS bench, row_number() OVER (PARTITION BY r.symbol ORDER BY r.date DESC) AS k FROM returns r JOIN benchmark_returns b USING (date))
SELECT symbol, CASE WHEN count(*) >= 30 THEN covar_samp(ret, bench) / var_samp(bench) ELSE 0 END AS beta, count(*) AS n_common FROM p WHERE k <= 252 GROUP BY symbol""",
       "benchmark_returns", r6="beta")
def _(t: Tables):
    return s.beta(t.returns, t.benchmark)


AB = """SELECT symbol, beta, (m - (0.02 / 252 + beta * (mb - 0.02 / 252))) * 252 AS alpha FROM (
  SELECT r.symbol, covar_samp(r.ret, b.ret) / var_samp(b.ret) AS beta, avg(r.ret) AS m, avg(b.ret) AS mb FROM {src} r JOIN benchmark_returns b USING (date) GROUP BY 1)"""


@query("alpha", f"SELECT symbol, alpha FROM ({AB.format(src='returns')})", "benchmark_returns", r6="alpha")
def _(t: Tables):
    return s.alpha(s.with_benchmark(t.returns, t.benchmark), 0.02).select("symbol", "alpha")


@query("alpha_beta", AB.format(src="portfolio_series"), "benchmark_returns portfolio_series", r6="alpha beta")
def _(t: Tables):
    return s.alpha(s.with_benchmark(t.portfolio_series, t.benchmark), 0.02)


Z95 = NormalDist().inv_cdf(1 - 0.95)


@query("var_historical", "SELECT symbol, -quantile_cont(ret, 0.05) AS var FROM returns GROUP BY symbol", "returns", r6="var")
def _(t: Tables):
    return s.value_at_risk(t.returns)


@query("var_parametric", f"SELECT symbol, -(avg(ret) + {Z95} * stddev_samp(ret)) AS var FROM returns GROUP BY symbol", "returns", r6="var")
def _(t: Tables):
    return s.value_at_risk(t.returns, method="parametric")


A = abs(Z95)


@query("var_cornish_fisher", f"""SELECT symbol, -(m - ({A} + {A * A - 1} * s / 6 + {A**3 - 3 * A} * k / 24 - {2 * A**3 - 5 * A} * s * s / 36) * sd) AS var FROM (
  SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS sd, {skew('ret')} AS s, {kurt('ret')} AS k FROM returns GROUP BY symbol)""", "returns", r6="var")
def _(t: Tables):
    return s.value_at_risk(t.returns, method="cornish_fisher")


@query("var_monte_carlo")
def _(t: Tables):
    return s.value_at_risk(t.returns, method="monte_carlo")


@query("cvar", """, v AS (SELECT symbol, -quantile_cont(ret, 0.05) AS var FROM returns GROUP BY symbol)
SELECT symbol, var, coalesce(-avg(CASE WHEN ret <= -var THEN ret END), var) AS cvar FROM returns JOIN v USING (symbol) GROUP BY symbol, var""", "returns", r6="var cvar")
def _(t: Tables):
    return s.expected_shortfall(t.returns)


@query("cvar_parametric", f"SELECT symbol, -(avg(ret) - stddev_samp(ret) * {NormalDist().pdf(Z95) / 0.05}) AS cvar FROM returns GROUP BY symbol", "returns", r6="cvar")
def _(t: Tables):
    return s.expected_shortfall(t.returns, 0.95, "parametric")


LV = (("95", 0.95), ("99", 0.99), ("999", 0.999))


@query("tail_risk", f""", v AS (SELECT symbol, {', '.join(f'-quantile_cont(ret, {1 - q:.3f}) AS var_{k}' for k, q in LV)} FROM returns GROUP BY symbol),
a AS (SELECT symbol, count(*)::DOUBLE AS n, avg(ret) AS mean, stddev_samp(ret) AS std, {skew('ret')} AS skewness, {kurt('ret')} AS kurtosis,
  {', '.join(f'any_value(var_{k}) AS var_{k}, coalesce(-avg(CASE WHEN ret <= -var_{k} THEN ret END), any_value(var_{k})) AS cvar_{k}' for k, _ in LV)},
  count_if(ret < 0) AS dn, avg(CASE WHEN ret < 0 THEN ret END) AS d, avg(CASE WHEN ret >= 0 THEN ret END) AS u FROM returns JOIN v USING (symbol) GROUP BY symbol),
b AS (SELECT *, n / 6 * (skewness * skewness + kurtosis * kurtosis / 4) AS jarque_bera, CASE WHEN n >= 8 THEN {st.omnibus_expr('n', 'skewness', 'kurtosis')} END AS omnibus FROM a)
SELECT * EXCLUDE (dn, d, u), exp(-jarque_bera / 2) AS jarque_bera_p, exp(-omnibus / 2) AS omnibus_p, CASE WHEN dn > 10 AND n - dn > 10 THEN d / u END AS down_to_normal_ratio FROM b""", "returns",
       r6="mean std skewness kurtosis var_95 var_99 var_999 cvar_95 cvar_99 cvar_999 jarque_bera jarque_bera_p omnibus omnibus_p down_to_normal_ratio")
def _(t: Tables):
    return s.tail_risk(t.returns)


@query("portfolio_statistics", f""", {dd_cte('portfolio_series')}, {MDD},
v AS (SELECT symbol, -quantile_cont(ret, 0.05) AS var_95, -quantile_cont(ret, 0.01) AS var_99 FROM portfolio_series GROUP BY symbol),
a AS (SELECT symbol, exp(sum(ln(1 + ret))) - 1 AS total_return, count(*) AS periods, stddev_samp(ret) * sqrt(252) AS annualized_volatility,
  avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) AS sortino_ratio,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS downside_risk, any_value(var_95) AS var_95, any_value(var_99) AS var_99,
  -avg(CASE WHEN ret <= -var_95 THEN ret END) AS cvar_95, avg((ret > 0)::INT) AS positive_periods, avg((ret < 0)::INT) AS negative_periods,
  max(ret) AS best_period, min(ret) AS worst_period, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis FROM portfolio_series JOIN v USING (symbol) GROUP BY symbol),
b AS (SELECT p.symbol, covar_samp(p.ret, q.ret) / var_samp(q.ret) AS beta, exp(sum(ln(1 + q.ret))) - 1 AS bt, count(*) AS bn, avg(p.ret - q.ret) / stddev_samp(p.ret - q.ret) * sqrt(252) AS information_ratio,
  stddev_samp(p.ret - q.ret) * sqrt(252) AS tracking_error, corr(p.ret, q.ret) AS correlation FROM portfolio_series p JOIN benchmark_returns q USING (date) GROUP BY 1),
c AS (SELECT *, pow(1 + total_return, 252.0 / periods) - 1 AS annualized_return FROM a JOIN b USING (symbol) JOIN mdd USING (symbol))
SELECT * EXCLUDE (bt, bn), annualized_return / annualized_volatility AS return_risk_ratio, annualized_return - beta * (pow(1 + bt, 252.0 / bn) - 1) AS alpha,
  correlation * correlation AS r_squared, annualized_return / beta AS treynor_ratio FROM c""", "portfolio_series benchmark_returns",
       r6="""total_return annualized_volatility sharpe_ratio sortino_ratio downside_risk var_95 var_99 cvar_95 positive_periods negative_periods best_period
       worst_period skewness kurtosis beta information_ratio tracking_error correlation annualized_return return_risk_ratio alpha r_squared treynor_ratio max_drawdown""")
def _(t: Tables):
    return s.portfolio_statistics(t.portfolio_series, t.benchmark)


@query("portfolio_moments", f"""SELECT symbol AS portfolio_id, avg(ret) AS mean, var_samp(ret) AS variance, stddev_samp(ret) AS volatility, {skew('ret')} AS skewness, {kurt('ret')} AS kurtosis
FROM portfolio_series GROUP BY symbol""", "portfolio_series", r6="mean volatility skewness kurtosis", r9="variance")
def _(t: Tables):
    return s.portfolio_moments(t.portfolio_series).withColumnRenamed("symbol", "portfolio_id")


SEC = "sec AS (SELECT sector AS symbol, date, avg(ret) AS ret FROM returns JOIN securities USING (symbol) GROUP BY 1, 2)"


@query("sector_performance", f""", {SEC}, {dd_cte('sec')}, a AS (SELECT symbol, avg(ret) AS mean_return, stddev_pop(ret) AS volatility, min(drawdown) AS max_drawdown, avg(ret) / stddev_pop(ret) AS sharpe FROM dd GROUP BY 1)
SELECT *, CAST(rank() OVER (ORDER BY mean_return DESC) AS INTEGER) AS rank_return, CAST(rank() OVER (ORDER BY sharpe DESC) AS INTEGER) AS rank_sharpe,
  CAST(rank() OVER (ORDER BY volatility) AS INTEGER) AS rank_volatility FROM a""", "returns securities", r6="mean_return volatility max_drawdown sharpe")
def _(t: Tables):
    sec = t.returns.join(t.securities.select("symbol", "sector"), "symbol")
    return s.sector_performance(sec.groupBy(F.col("sector").alias("symbol"), "date").agg(F.avg("ret").alias("ret")))
