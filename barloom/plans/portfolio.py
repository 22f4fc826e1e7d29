"""Plans for joins, pairs, portfolios, peers, news aggregates, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import rate, running_product, series
from barloom.operators import news as nw
from barloom.operators import optimizer, pairs, peers
from barloom.operators import portfolio as pf
from barloom.operators import statistics as s
from barloom.plans.oracle import W
from barloom.plans.statistics import RP, dd_cte
from barloom.registry import query
from barloom.sources.tables import Tables

PS = "portfolio_series"
NB = "returns benchmark_returns"

# ---- alignment ----


@query("align_outer", """, c AS (SELECT asset_class, date, avg(ret) AS ret FROM returns JOIN securities USING (symbol) GROUP BY 1, 2)
SELECT date, coalesce(max(CASE WHEN asset_class = 'AFRICA' THEN ret END), 0) AS africa, coalesce(max(CASE WHEN asset_class = 'AMERICA' THEN ret END), 0) AS america,
  coalesce(max(CASE WHEN asset_class = 'ASIA' THEN ret END), 0) AS asia, coalesce(max(CASE WHEN asset_class = 'EUROPE' THEN ret END), 0) AS europe,
  coalesce(max(CASE WHEN asset_class = 'MIDDLE EAST' THEN ret END), 0) AS middle_east FROM c GROUP BY date""", "returns securities", r6="africa america asia europe middle_east")
def _(t: Tables):
    # the five class names are a fixed list, so the pivot needs no pass to find them
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = t.returns.join(t.securities.select("symbol", "asset_class"), "symbol").groupBy("date").pivot("asset_class", names).agg(F.avg("ret"))
    return wide.na.fill(0.0, names).select("date", *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in names])


@query("align_tail", f""", a AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM returns),
b AS (SELECT ret AS bench, row_number() OVER (ORDER BY date DESC) AS k FROM benchmark_returns) SELECT symbol, k, ret, bench FROM a JOIN b USING (k)""", NB, r6="ret bench")
def _(t: Tables):
    from pyspark.sql import Window

    # the benchmark has one row per date, so ranking it in one partition is bounded by the calendar
    b = t.benchmark.select(F.col("ret").alias("bench"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("date"))).alias("k"))
    a = t.returns.select("symbol", "ret", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))).alias("k"))
    return a.join(F.broadcast(b), "k").select("symbol", F.col("k").cast("bigint").alias("k"), "ret", "bench")


@query("lookup_default", """SELECT symbol, coalesce(sector, 'Unknown') AS sector FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN securities USING (symbol)""", "bars securities")
def _(t: Tables):
    return t.bars.select("symbol").distinct().join(t.securities.select("symbol", "sector"), "symbol", "left").na.fill("Unknown", ["sector"])


SPJ = f""", d AS (SELECT symbol, date, avg(sentiment) AS s FROM news GROUP BY 1, 2), l AS (SELECT symbol, date, lag(s) OVER ({W}) AS sentiment FROM d),
r AS (SELECT symbol, date, close / lag(close) OVER ({W}) - 1 AS ret FROM event_bars),
j AS (SELECT r.symbol, r.date, ret, sentiment FROM r JOIN l USING (symbol, date) WHERE ret IS NOT NULL AND sentiment IS NOT NULL)"""


@query("sentiment_price_join", f"{SPJ} SELECT * FROM j", "news event_bars", r6="ret sentiment")
def _(t: Tables):
    return nw.sentiment_price_join(t.event_bars, t.news)


@query("sentiment_impact", f"""{SPJ} SELECT symbol, corr(ret, sentiment) AS correlation, coalesce(avg(CASE WHEN sentiment > 0.3 THEN ret END), 0) AS avg_return_after_positive,
  coalesce(avg(CASE WHEN sentiment < -0.3 THEN ret END), 0) AS avg_return_after_negative, coalesce(avg(CASE WHEN sentiment BETWEEN -0.3 AND 0.3 THEN ret END), 0) AS avg_return_after_neutral,
  coalesce(count_if((sentiment > 0.3 AND ret > 0) OR (sentiment < -0.3 AND ret < 0)) * 100.0 / nullif(count_if(abs(sentiment) > 0.3), 0), 0) AS sentiment_accuracy, count(*) AS data_points FROM j GROUP BY symbol""",
       "news event_bars", r6="correlation avg_return_after_positive avg_return_after_negative avg_return_after_neutral sentiment_accuracy")
def _(t: Tables):
    return nw.sentiment_impact(nw.sentiment_price_join(t.event_bars, t.news))


PAIR = """, ld AS (SELECT DISTINCT date FROM returns ORDER BY date DESC LIMIT {n}), rw AS (SELECT * FROM returns JOIN ld USING (date)),
pr AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n, covar_samp(a.ret, b.ret) AS covariance, corr(a.ret, b.ret) AS correlation
  FROM rw a JOIN rw b ON a.date = b.date AND a.symbol {op} b.symbol GROUP BY 1, 2)"""


@query("pair_self_join", "SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n FROM returns a JOIN returns b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2",
       "returns")
def _(t: Tables):
    return pairs.pairwise(t.returns, "ret", None, measures=("n",))


@query("correlation_matrix", PAIR.format(n=252, op="<") + " SELECT symbol_a, symbol_b, n, correlation FROM pr WHERE n >= 5", "returns", r6="correlation")
def _(t: Tables):
    return pairs.pairwise(t.returns, "ret", 252, min_common=5, measures=("n", "correlation"))


@query("correlation_spearman", PAIR.format(n=252, op="<") + """, j AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.date,
  rank() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ret) + (count(*) OVER (PARTITION BY a.symbol, b.symbol, a.ret) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY a.symbol, b.symbol ORDER BY b.ret) + (count(*) OVER (PARTITION BY a.symbol, b.symbol, b.ret) - 1) / 2.0 AS rb
  FROM rw a JOIN rw b ON a.date = b.date AND a.symbol < b.symbol)
SELECT symbol_a, symbol_b, corr(ra, rb) AS correlation FROM j GROUP BY 1, 2 HAVING count(*) >= 5""", "returns", r6="correlation")
def _(t: Tables):
    return pairs.pairwise(t.returns, "ret", 252, "spearman", min_common=5, block=64, measures=("correlation",))


@query("correlation_kendall", PAIR.format(n=252, op="<") + """, j AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.date, a.ret AS x, b.ret AS y FROM rw a JOIN rw b ON a.date = b.date AND a.symbol < b.symbol),
k AS (SELECT p.symbol_a, p.symbol_b, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS num, sum(abs(sign(p.x - q.x))) AS dx, sum(abs(sign(p.y - q.y))) AS dy, count(DISTINCT p.date) AS n
  FROM j p JOIN j q ON p.symbol_a = q.symbol_a AND p.symbol_b = q.symbol_b GROUP BY 1, 2)
SELECT symbol_a, symbol_b, num / sqrt(dx::DOUBLE * dy) AS correlation FROM k WHERE n >= 5""", "returns", r6="correlation")
def _(t: Tables):
    return pairs.pairwise(t.returns, "ret", 252, "kendall", min_common=5, block=64, measures=("correlation",))


@query("price_correlation", """, ld AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 252), rw AS (SELECT * FROM bars JOIN ld USING (date))
SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, corr(a.close, b.close) AS correlation FROM rw a JOIN rw b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 5""",
       "bars", r6="correlation")
def _(t: Tables):
    return pairs.pairwise(t.bars, "close", 252, min_common=5, measures=("correlation",))


@query("covariance_matrix", PAIR.format(n=252, op="<=") + " SELECT symbol_a, symbol_b, covariance * 252 AS covariance FROM pr WHERE n >= 5", "returns", r6="covariance")
def _(t: Tables):
    df = pairs.pairwise(t.returns, "ret", 252, diagonal=True, min_common=5, measures=("covariance",))
    return df.select("symbol_a", "symbol_b", (F.col("covariance") * 252).alias("covariance"))


@query("find_pairs", PAIR.format(n=252, op="<") + " SELECT symbol_a, symbol_b, correlation, n FROM pr WHERE n >= 5 AND correlation > 0.6", "returns", r6="correlation")
def _(t: Tables):
    return pairs.find_pairs(t.returns, 0.6, 252, 5)


# ---- portfolio ----


@query("normalize_weights", """, w AS (SELECT symbol, balance AS weight FROM securities) SELECT 1 AS portfolio_id, symbol, weight / sum(weight) OVER () AS weight FROM w""", "securities", r9="weight")
def _(t: Tables):
    raw = t.securities.select(F.lit(1).alias("portfolio_id"), "symbol", F.col("balance").alias("weight"))
    return pf.normalize_weights(raw)


@query("portfolio_returns", "SELECT symbol AS portfolio_id, date, ret FROM portfolio_series", PS, r9="ret")
def _(t: Tables):
    return pf.portfolio_returns(t.returns, t.weights)


PM = f""", {dd_cte(PS)}, pm AS (SELECT symbol AS portfolio_id, avg(ret) * 252 AS mean_return, stddev_samp(ret) * sqrt(252) AS volatility, min(drawdown) AS max_drawdown,
  arg_max(curve, date) - 1 AS total_return, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe_ratio FROM dd GROUP BY 1)"""
PMC = "mean_return volatility max_drawdown total_return sharpe_ratio"


@query("portfolio_metrics", f"{PM} SELECT * FROM pm", PS, r6=PMC)
def _(t: Tables):
    return pf.portfolio_metrics(pf.portfolio_returns(t.returns, t.weights))


RISK = """, dates AS (SELECT DISTINCT date FROM returns), zf AS (SELECT s.symbol, d.date, coalesce(r.ret, 0) AS r FROM dates d CROSS JOIN (SELECT DISTINCT symbol FROM returns) s
  LEFT JOIN returns r ON r.symbol = s.symbol AND r.date = d.date),
zp AS (SELECT portfolio_id, date, sum(weight * r) AS p FROM zf JOIN weights USING (symbol) GROUP BY 1, 2),
a AS (SELECT w.portfolio_id, z.symbol, any_value(w.weight) AS weight, covar_samp(z.r, b.ret) / var_samp(b.ret) AS beta, covar_samp(z.r, zp.p) * 252 / sqrt(var_samp(zp.p) * 252) AS marginal_contribution,
  sqrt(var_samp(z.r) * 252) AS av, sqrt(var_samp(zp.p) * 252) AS volatility FROM zf z JOIN weights w USING (symbol) JOIN zp ON zp.portfolio_id = w.portfolio_id AND zp.date = z.date JOIN benchmark_returns b ON b.date = z.date GROUP BY 1, 2),
rk AS (SELECT portfolio_id, symbol, weight, beta, marginal_contribution, weight * marginal_contribution AS component_contribution, weight * marginal_contribution / volatility * 100 AS percent_contribution,
  volatility, sum(weight * av) OVER (PARTITION BY portfolio_id) / volatility AS diversification_ratio FROM a)"""


@query("portfolio_risk", f"{RISK} SELECT * FROM rk", f"{PS} benchmark_returns",
       r6="weight beta marginal_contribution component_contribution percent_contribution volatility diversification_ratio", stored=True)
def _(t: Tables):
    return pf.portfolio_risk(t.returns, t.weights, t.benchmark)


@query("portfolio_risk_report", f"""{RISK}, {dd_cte(PS)}, v AS (SELECT symbol, -quantile_cont(ret, 0.05) AS var_95 FROM portfolio_series GROUP BY 1),
cv AS (SELECT symbol, any_value(var_95) AS var_95, -avg(CASE WHEN ret <= -var_95 THEN ret END) AS cvar_95 FROM portfolio_series JOIN v USING (symbol) GROUP BY 1),
i AS (SELECT *, row_number() OVER ({W}) - sum((drawdown < 0)::INT) {RP} AS isl FROM dd), g AS (SELECT symbol, isl, count(*) AS len FROM i WHERE drawdown < 0 GROUP BY 1, 2),
p AS (SELECT symbol, avg(len) AS drawdown_duration FROM g GROUP BY 1), d AS (SELECT symbol, min(drawdown) * 100 AS max_drawdown, avg(CASE WHEN drawdown < 0 THEN drawdown * 100 END) AS avg_drawdown FROM dd GROUP BY 1),
r AS (SELECT portfolio_id AS symbol, max(volatility) AS volatility, max(diversification_ratio) AS diversification_ratio FROM rk GROUP BY 1)
SELECT symbol AS portfolio_id, * EXCLUDE (symbol) FROM r JOIN cv USING (symbol) JOIN d USING (symbol) JOIN p USING (symbol)""", f"{PS} benchmark_returns",
       r6="volatility diversification_ratio var_95 cvar_95 max_drawdown avg_drawdown drawdown_duration", stored=True)
def _(t: Tables):
    return pf.portfolio_risk_report(t.returns, t.weights, t.benchmark)


# One asset word per region so that every scenario rule has matches.
WORDS = {"AFRICA": "bond fund", "AMERICA": "tech share", "ASIA": "equity fund", "EUROPE": "treasury note", "MIDDLE EAST": "commodity"}
NAMED = "nm AS (SELECT symbol, CASE asset_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " END AS name FROM securities)"


def named(t: Tables):
    m = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return t.securities.select("symbol", m[F.col("asset_class")].alias("name"))


@query("scenario_stress", f""", {NAMED}, sc AS (
  SELECT symbol, 'market_crash' AS scenario, CASE WHEN name LIKE '%bond%' THEN -0.05 ELSE -0.15 END::DOUBLE AS shock FROM nm
  UNION ALL SELECT symbol, 'inflation_spike', CASE WHEN name LIKE '%bond%' OR name LIKE '%treasury%' THEN -0.10 ELSE 0.05 END FROM nm
  UNION ALL SELECT symbol, 'tech_bubble', CASE WHEN name LIKE '%tech%' THEN -0.25 ELSE -0.05 END FROM nm
  UNION ALL SELECT symbol, 'recession', CASE WHEN name LIKE '%equity%' THEN -0.20 WHEN name LIKE '%bond%' THEN 0.05 ELSE -0.10 END FROM nm)
SELECT portfolio_id, scenario, sum(weight * shock) * 100 AS portfolio_impact, arg_max(symbol, (abs(shock), -symbol)) AS worst_asset, arg_max(shock, (abs(shock), -symbol)) AS worst_shock
FROM weights JOIN sc USING (symbol) GROUP BY 1, 2""", "weights securities", r6="portfolio_impact")
def _(t: Tables):
    return pf.scenario_stress(t.weights, named(t))


@query("historical_stress", """, d AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM returns GROUP BY 1)
SELECT portfolio_id, sum(weight * lo) * 100 AS worst_day_impact, sum(weight * hi) * 100 AS best_day_impact FROM weights JOIN d USING (symbol) GROUP BY 1""", "returns weights", r6="worst_day_impact best_day_impact")
def _(t: Tables):
    return pf.historical_stress(t.returns, t.weights)


FACTORS = {"mild": 0.5, "severe": 2.0, "inverse": -1.0}


@query("factor_stress", f""", f AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in FACTORS.items())}) t(scenario, f))
SELECT symbol, scenario, -quantile_cont(ret * f, 0.05) AS var, avg(ret * f) / stddev_samp(ret * f) * sqrt(252) AS sharpe, stddev_samp(ret * f) * sqrt(252) AS volatility FROM returns CROSS JOIN f GROUP BY 1, 2""",
       "returns", r6="var sharpe volatility")
def _(t: Tables):
    return pf.factor_stress(t.returns, FACTORS)


TOT = "tot AS (SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS ret FROM bars GROUP BY 1)"


def totals(t: Tables):
    return t.bars.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ret"))


@query("attribution", f""", {TOT} SELECT portfolio_id, symbol, weight, ret, weight * ret AS contribution, sum(weight * ret) OVER (PARTITION BY portfolio_id) AS total_return,
  weight * ret / sum(weight * ret) OVER (PARTITION BY portfolio_id) AS attribution FROM weights JOIN tot USING (symbol)""", "weights", r6="ret total_return attribution", r9="weight contribution")
def _(t: Tables):
    return pf.attribution(t.weights, totals(t))


@query("self_assess_benchmark", """, j AS (SELECT p.symbol AS portfolio_id, p.ret, b.ret AS bench FROM portfolio_series p JOIN benchmark_returns b USING (date)),
a AS (SELECT portfolio_id, exp(sum(ln(1 + ret))) - 1 AS total_return, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, exp(sum(ln(1 + bench))) - 1 AS benchmark_return,
  avg(bench) / stddev_samp(bench) * sqrt(252) AS benchmark_sharpe, covar_samp(ret, bench) / var_samp(bench) AS beta, stddev_pop(ret - bench) AS tracking_error, avg(ret) AS m, avg(bench) AS b FROM j GROUP BY 1)
SELECT * EXCLUDE (m, b), (m - beta * b) * 252 AS alpha FROM a""", f"{PS} benchmark_returns", r6="total_return sharpe benchmark_return benchmark_sharpe beta tracking_error alpha")
def _(t: Tables):
    return pf.self_assess_benchmark(s.with_benchmark(t.portfolio_series, t.benchmark))


TC = """tg AS (SELECT symbol, weight AS target_weight FROM weights WHERE portfolio_id = 2), cu AS (SELECT symbol, quantity * current_price AS current_value FROM holdings),
ro AS (SELECT symbol, coalesce(target_weight, 0) AS target_weight, coalesce(current_value, 0) AS current_value FROM tg FULL JOIN cu USING (symbol))"""


def target_current(t: Tables):
    return (t.weights.where("portfolio_id = 2").select("symbol", "weight"),
            t.holdings.select("symbol", (F.col("quantity") * F.col("current_price")).alias("value")))


@query("rebalance_outer", f", {TC} SELECT * FROM ro", "weights holdings", r9="target_weight")
def _(t: Tables):
    return pf.rebalance_outer(*target_current(t))


@query("rebalance_trades", f""", {TC}, x AS (SELECT *, sum(current_value) OVER () AS tv FROM ro)
SELECT symbol, target_weight, current_value, current_value / tv AS current_weight, tv * target_weight - current_value AS trade FROM x WHERE abs(tv * target_weight - current_value) >= 100""",
       "weights holdings", r9="target_weight current_weight", r4="trade")
def _(t: Tables):
    return pf.rebalance_trades(*target_current(t))


@query("rebalance_actions", """, w AS (SELECT symbol, balance / sum(balance) OVER () AS target FROM securities), c AS (SELECT symbol, weight AS current FROM weights WHERE portfolio_id = 1),
d AS (SELECT symbol, current, coalesce(target, 0) AS target, coalesce(target, 0) - current AS difference FROM c LEFT JOIN w USING (symbol))
SELECT *, CASE WHEN difference > 0 THEN 'buy' ELSE 'sell' END AS action, abs(difference) AS amount FROM d WHERE abs(difference) > 0.005""", "weights securities", r9="current target difference amount")
def _(t: Tables):
    raw = t.securities.select(F.lit(1).alias("portfolio_id"), "symbol", F.col("balance").alias("weight"))
    return pf.rebalance_actions(t.weights.where("portfolio_id = 1"), pf.normalize_weights(raw), 0.005)


@query("recommend_equal", f"""{PM} SELECT * EXCLUDE (portfolio_id), 'moderate' AS risk_tolerance, 0.15::DOUBLE AS target_volatility, (SELECT max(weight) FROM weights WHERE portfolio_id = 1) AS weight,
  (SELECT count(DISTINCT symbol) FROM returns) AS assets FROM pm WHERE portfolio_id = 1""", PS, r6=PMC)
def _(t: Tables):
    return pf.recommend_equal(t.returns)


@query("assess_scores", f"""{PM}, a AS (SELECT portfolio_id, count_if(weight > 0.01) AS asset_count, max(weight) AS max_weight FROM weights GROUP BY 1),
b AS (SELECT portfolio_id, CAST(asset_count AS BIGINT) AS asset_count, max_weight, volatility, max_drawdown, CASE WHEN asset_count < 5 THEN 3 WHEN max_weight > 0.25 THEN 5 ELSE 8 END AS diversification_score,
  CASE WHEN volatility > 0.25 THEN 3 WHEN max_drawdown < -0.25 THEN 4 ELSE 7 END AS risk_score, 0 AS liquidity_score FROM a JOIN pm USING (portfolio_id))
SELECT *, (diversification_score + risk_score) / 3 AS overall_score, concat_ws('; ', CASE WHEN asset_count < 5 THEN 'Too few assets: spread the money over more of them'
  WHEN max_weight > 0.25 THEN 'One position outweighs the rest: trim it' END, CASE WHEN volatility > 0.25 THEN 'Prices swing widely: hold calmer assets'
  WHEN max_drawdown < -0.25 THEN 'Past falls were deep: hedge or hold more cash' END) AS recommendations FROM b""", PS, r6="max_weight volatility max_drawdown overall_score")
def _(t: Tables):
    return pf.assess_scores(t.weights, pf.portfolio_metrics(pf.portfolio_returns(t.returns, t.weights)))


EXP = """, ex AS (SELECT portfolio_id, 'sector' AS kind, sector AS label, sum(weight) AS exposure FROM weights JOIN securities USING (symbol) GROUP BY 1, 3
UNION ALL SELECT portfolio_id, 'asset_class', asset_class, sum(weight) FROM weights JOIN securities USING (symbol) GROUP BY 1, 3)"""


@query("exposures", f"{EXP} SELECT * FROM ex", "weights securities", r9="exposure")
def _(t: Tables):
    return pf.exposures(t.weights, t.securities)


@query("exposure_limits", f"{EXP} SELECT *, CASE WHEN exposure > 0.235 THEN 'over' ELSE 'under' END AS status FROM ex WHERE exposure > 0.235 OR exposure < 0.015", "weights securities", r9="exposure")
def _(t: Tables):
    return pf.exposure_limits(pf.exposures(t.weights, t.securities), 0.235, 0.015)


@query("allocation", """, v AS (SELECT symbol, sector, asset_class, quantity * current_price AS value, sum(quantity * current_price) OVER () AS tv FROM holdings JOIN securities USING (symbol)),
u AS (SELECT 'symbol' AS kind, CAST(symbol AS VARCHAR) AS label, value, tv FROM v UNION ALL SELECT 'sector', sector, value, tv FROM v UNION ALL SELECT 'asset_class', asset_class, value, tv FROM v)
SELECT kind, label, sum(value) AS value, sum(value) / any_value(tv) * 100 AS share FROM u GROUP BY 1, 2""", "holdings securities", r4="value", r6="share")
def _(t: Tables):
    return pf.allocation(t.holdings, t.securities)


@query("holdings_pnl", """, h AS (SELECT symbol, quantity * purchase_price AS cost_basis, quantity * current_price AS current_value, CAST(DATE '2024-01-01' - purchase_date AS INTEGER) AS days_held FROM holdings
UNION ALL SELECT NULL, sum(quantity * purchase_price), sum(quantity * current_price), NULL FROM holdings)
SELECT *, current_value - cost_basis AS gain_loss, (current_value - cost_basis) / cost_basis * 100 AS gain_loss_pct FROM h""", "holdings", r4="cost_basis current_value gain_loss", r6="gain_loss_pct")
def _(t: Tables):
    return pf.holdings_pnl(t.holdings, F.lit("2024-01-01").cast("date"))


@query("dividend_income", "SELECT symbol, quantity, current_price, dividend_yield, frequency, dividend_yield / 100 * current_price * quantity AS annual_income FROM holdings", "holdings", r4="annual_income")
def _(t: Tables):
    return pf.dividend_income(t.holdings)


@query("dividend_summary", """, i AS (SELECT *, dividend_yield / 100 * current_price * quantity AS inc FROM holdings) SELECT sum(inc) AS total_annual_income,
  """ + ", ".join(f"sum(CASE WHEN frequency = '{k}' THEN inc ELSE 0 END) AS income_{k}" for k in pf.FREQUENCIES) + ", sum(inc) / sum(quantity * current_price) * 100 AS portfolio_yield FROM i", "holdings",
       r4="total_annual_income income_annual income_semi_annual income_quarterly income_monthly", r6="portfolio_yield")
def _(t: Tables):
    return pf.dividend_summary(t.holdings)


@query("cumulative_vs_benchmark", f""", j AS (SELECT p.symbol, p.date, p.ret, coalesce(b.ret, 0) AS bench FROM portfolio_series p LEFT JOIN benchmark_returns b USING (date)),
c AS (SELECT symbol, date, exp(sum(ln(1 + ret)) {RP}) AS c, exp(sum(ln(1 + bench)) {RP}) - 1 AS benchmark_cumulative FROM j)
SELECT symbol AS portfolio_id, date, c - 1 AS cumulative, benchmark_cumulative, c / max(c) {RP} - 1 AS drawdown FROM c""", f"{PS} benchmark_returns", r6="cumulative benchmark_cumulative drawdown")
def _(t: Tables):
    port = pf.portfolio_returns(t.returns, t.weights)
    return pf.cumulative_vs_benchmark(port, t.benchmark)


@query("predicted_portfolio", """, f AS (SELECT symbol, arg_max(y_true, date) AS current_price, arg_max(y_pred, date) AS predicted_price FROM predictions WHERE model = 'mean5' GROUP BY 1),
a AS (SELECT portfolio_id, sum(weight * current_price) AS current_value, sum(weight * predicted_price) AS predicted_value FROM weights JOIN f USING (symbol) GROUP BY 1)
SELECT *, (predicted_value - current_value) / current_value AS predicted_return FROM a""", "weights predictions", r4="current_value predicted_value", r6="predicted_return")
def _(t: Tables):
    f = t.predictions.where("model = 'mean5'").groupBy("symbol").agg(F.max_by("y_true", "date").alias("current_price"), F.max_by("y_pred", "date").alias("predicted_price"))
    return pf.predicted_portfolio(t.weights, f)


@query("weight_search", stored=True)
def _(t: Tables):
    return optimizer.weight_search(t.returns, target_return=0.085, target_volatility=0.1)


@query("efficient_frontier", stored=True)
def _(t: Tables):
    return optimizer.efficient_frontier(t.returns)


@query("capital_market_line", stored=True)
def _(t: Tables):
    return pf.capital_market_line(optimizer.weight_search(t.returns, 0.02), 0.02)


# ---- peers ----

TGT = "(SELECT min(symbol) FROM returns)"
PEER = f""", i AS (SELECT *, row_number() OVER ({W}) AS i FROM returns), tg AS (SELECT i, ret AS t FROM i WHERE symbol = {TGT}),
a AS (SELECT symbol, corr(ret, t) AS correlation, count(t) AS n, avg(ret) AS mean_return, stddev_pop(ret) AS volatility, covar_samp(ret, t) / var_samp(CASE WHEN t IS NOT NULL THEN t END) AS beta
  FROM i LEFT JOIN tg USING (i) WHERE symbol <> {TGT} GROUP BY 1 HAVING count(t) = (SELECT count(*) FROM tg) ORDER BY abs(correlation) DESC, symbol LIMIT 5)"""


@query("peer_compare", f"{PEER} SELECT * FROM a", "returns", r6="correlation mean_return volatility beta", stored=True)
def _(t: Tables):
    first = t.returns.agg(F.min("symbol")).scalar()
    return peers.peer_compare(t.returns, first).drop("p_value", "significance")


@query("peer_sheet", f"""{PEER} SELECT 'peer' AS role, symbol, mean_return, volatility, correlation, beta FROM a UNION ALL
SELECT 'target', symbol, avg(ret), stddev_pop(ret), NULL, NULL FROM returns WHERE symbol = {TGT} GROUP BY symbol""", "returns", r6="correlation mean_return volatility beta", stored=True)
def _(t: Tables):
    first = t.returns.agg(F.min("symbol")).scalar()
    return peers.peer_sheet(t.returns, first).select("role", "symbol", "mean_return", "volatility", "correlation", "beta")


@query("peer_significance", stored=True)
def _(t: Tables):
    first = t.returns.agg(F.min("symbol")).scalar()
    return peers.peer_compare(t.returns, first).select("symbol", "correlation", "n", F.round("p_value", 9).alias("p_value"), "significance")


@query("top_peers", f""", tg AS (SELECT date, ret AS t FROM returns WHERE symbol = {TGT}),
a AS (SELECT symbol, corr(ret, t) AS correlation, count(*) AS n, covar_samp(ret, t) / var_samp(t) AS beta, avg(ret) AS mean_return, stddev_pop(ret) AS volatility FROM returns JOIN tg USING (date) WHERE symbol <> {TGT} GROUP BY 1 HAVING count(*) >= 20),
z AS (SELECT symbol, sum(volume * close) AS size FROM bars GROUP BY 1),
b AS (SELECT a.*, size / (SELECT size FROM z WHERE symbol = {TGT}) AS relative_size FROM a JOIN z USING (symbol))
SELECT *, 0.5 * (abs(correlation) + 1) / 2 + 0.3 * (1 - least(abs(beta - 1), 1)) + 0.2 * (1 - least(abs(log10(relative_size)), 1)) AS similarity_score FROM b ORDER BY similarity_score DESC, symbol LIMIT 5""",
       "returns", r6="correlation beta mean_return volatility relative_size similarity_score", stored=True)
def _(t: Tables):
    first = t.returns.agg(F.min("symbol")).scalar()
    size = t.bars.groupBy("symbol").agg(F.sum(F.col("volume") * F.col("close")).alias("size"))
    return peers.top_peers(t.returns, first, size).drop("p_value")


# ---- news ----

CNT = "CAST(count_if(sentiment > 0.3) AS BIGINT) AS positive_count, CAST(count_if(sentiment < -0.3) AS BIGINT) AS negative_count, CAST(count_if(sentiment BETWEEN -0.3 AND 0.3) AS BIGINT) AS neutral_count"


@query("news_summary", f""", d AS (SELECT max(date) AS d FROM news) SELECT symbol, count(*) AS news_count, avg(sentiment) AS average_sentiment, stddev_pop(sentiment) AS sentiment_std, {CNT},
  CASE WHEN count(*) > 3 THEN coalesce(avg(CASE WHEN d - date <= 3 THEN sentiment END), 0) - coalesce(avg(CASE WHEN d - date > 3 THEN sentiment END), 0) ELSE 0 END AS sentiment_trend FROM news CROSS JOIN d GROUP BY symbol""",
       "news", r6="average_sentiment sentiment_std sentiment_trend")
def _(t: Tables):
    return nw.news_summary(t.news, t.news.agg(F.max("date")).scalar())


@query("social_summary", """, p AS (SELECT symbol, source, avg(sentiment) AS s, count(*) AS m FROM news GROUP BY 1, 2), a AS (SELECT symbol, CAST(sum(m) AS BIGINT) AS total_mentions, count(*) AS platforms, sum(s * m) / sum(m) AS overall_sentiment FROM p GROUP BY 1)
SELECT *, (overall_sentiment + 1) * 50 AS bullish_percentage FROM a""", "news", r6="overall_sentiment bullish_percentage")
def _(t: Tables):
    return nw.social_summary(t.news)


for grouping, label in (("day", "strftime(date, '%Y-%m-%d')"), ("week", "strftime(date, '%G-W%V')"), ("month", "strftime(date, '%Y-%m')")):
    @query("news_trends" if grouping == "day" else f"news_trends_{grouping}", f"SELECT {label} AS period, count(*) AS article_count, avg(sentiment) AS average_sentiment, {CNT} FROM news GROUP BY 1", "news", r6="average_sentiment")
    def _(t: Tables, grouping=grouping):
        return nw.news_trends(t.news, grouping)


@query("iso_week_label", "SELECT symbol, date, strftime(date, '%G-W%V') AS week FROM bars", "bars")
def _(t: Tables):
    return t.bars.select("symbol", "date", nw.iso_week_label().alias("week"))


@query("sentiment_class", "SELECT event_id, sentiment, CASE WHEN sentiment > 0.3 THEN 'positive' WHEN sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM news", "news", r6="sentiment")
def _(t: Tables):
    return t.news.select("event_id", "sentiment", nw.sentiment_class().alias("label"))


@query("compare_coverage", f"SELECT symbol, count(*) AS article_count, avg(sentiment) AS average_sentiment, {CNT}, count_if(sentiment > 0.3)::DOUBLE / greatest(count_if(sentiment < -0.3), 1) AS sentiment_ratio FROM news GROUP BY 1", "news", r6="average_sentiment sentiment_ratio")
def _(t: Tables):
    return nw.compare_coverage(t.news)


@query("earnings_surprises", """, e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM earnings WHERE eps_estimate IS NOT NULL),
f AS (SELECT *, eps_actual - eps_estimate AS d FROM e WHERE k <= 8)
SELECT symbol, count(*) AS periods_analyzed, CAST(count_if(d > 0) AS BIGINT) AS beat_count, CAST(count_if(d < 0) AS BIGINT) AS miss_count, CAST(count_if(d = 0) AS BIGINT) AS meet_count,
  avg(d / abs(eps_estimate) * 100) AS average_surprise_pct, count_if(d > 0) * 100.0 / count(*) AS beat_percentage FROM f GROUP BY 1""", "earnings", r6="average_surprise_pct beat_percentage")
def _(t: Tables):
    return nw.earnings_surprises(t.earnings)


@query("events_calendar", """SELECT event_id, source AS type, date, date > DATE '2024-01-15' AS is_estimate FROM news WHERE source IN ('purchase', 'signup') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""", "news")
def _(t: Tables):
    ev = t.news.select("event_id", F.col("source").alias("type"), "date")
    return nw.events_calendar(ev, ["purchase", "signup"], "2024-01-05", "2024-01-25", "2024-01-15")


@query("market_news", """, m AS (SELECT id, title, published, source, lower(title) AS lt FROM articles WHERE regexp_matches(concat_ws(' ', title, content), '(?i)the |und |des '))
SELECT id, title, published, source FROM m QUALIFY row_number() OVER (PARTITION BY lt ORDER BY published, id) = 1 ORDER BY published DESC, id LIMIT 100""", "articles")
def _(t: Tables):
    return nw.market_news(t.articles, ["the ", "und ", "des "]).select("id", "title", "published", "source")


# ---- ranking, paging, sets ----


@query("find_page", "SELECT symbol, date, close FROM bars WHERE volume >= 40 ORDER BY close DESC, symbol, date LIMIT 100", "bars")
def _(t: Tables):
    return t.bars.where("volume >= 40").select("symbol", "date", "close").orderBy(F.desc("close"), "symbol", "date").limit(100)


@query("count_where", "SELECT count(*) AS n FROM bars WHERE close > 100", "bars")
def _(t: Tables):
    return t.bars.where("close > 100").agg(F.count("*").alias("n"))


@query("top_n", "SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS score FROM events WHERE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) IS NOT NULL ORDER BY score DESC, event_id LIMIT 20")
def _(t: Tables):
    df = t.raw("events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("score"))
    return df.where("score IS NOT NULL").orderBy(F.desc("score"), "event_id").limit(20)


@query("latest_per_key", "SELECT event_type AS model_type, user_id AS symbol, max(event_id) AS event_id, max(ts) AS created_at FROM events GROUP BY 1, 2")
def _(t: Tables):
    ev = t.raw("events").select(F.col("event_type").alias("model_type"), F.col("user_id").alias("symbol"), "event_id", F.col("ts").alias("created_at"))
    top = ev.groupBy("model_type", "symbol").agg(F.max_by(F.struct("event_id", "created_at"), F.struct("created_at", "event_id")).alias("r"))
    return top.select("model_type", "symbol", "r.event_id", "r.created_at")


@query("recent_tail", "SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 20", "bars")
def _(t: Tables):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return t.bars.select("symbol", "date", "close", k.alias("k")).where("k <= 20").drop("k")


@query("quality_rank", """, q AS (SELECT symbol, balance * 1e6 AS market_cap, 10 + balance / 500 AS pe_ratio, balance / 200000 AS dividend_yield, balance / 40000 AS roe FROM securities),
sc AS (SELECT *, ((market_cap >= 1e9)::INT + (pe_ratio <= 30)::INT + (dividend_yield >= 0.01)::INT + (roe >= 0.15)::INT) * 25 AS quality_score FROM q)
SELECT symbol, quality_score, CASE WHEN quality_score > 85 THEN 'Strong Buy' WHEN quality_score > 75 THEN 'Buy' ELSE 'Hold' END AS recommendation FROM sc""", "securities")
def _(t: Tables):
    b = F.col("balance")
    facts = t.securities.select("symbol", (b * 1e6).alias("market_cap"), (10 + b / 500).alias("pe_ratio"), (b / 200000).alias("dividend_yield"), (b / 40000).alias("roe"))
    return quality_rank(facts)


def quality_rank(facts):
    """Share of met thresholds as a score, with a label."""
    tests = [F.col("market_cap") >= 1e9, F.col("pe_ratio") <= 30, F.col("dividend_yield") >= 0.01, F.col("roe") >= 0.15]
    score = sum(F.coalesce(c, F.lit(False)).cast("int") for c in tests) * 25
    df = facts.select("symbol", score.alias("quality_score"))
    label = F.when(F.col("quality_score") > 85, "Strong Buy").when(F.col("quality_score") > 75, "Buy").otherwise("Hold")
    return df.withColumn("recommendation", label)


@query("union_symbols", "SELECT symbol, date, close, volume, CAST(NULL AS DOUBLE) AS ret FROM bars UNION ALL SELECT symbol, date, NULL, NULL, ret FROM returns", "returns", r6="ret")
def _(t: Tables):
    return t.bars.select("symbol", "date", "close", "volume").unionByName(t.returns, allowMissingColumns=True)


@query("union_feeds", """, u AS (SELECT id, title, link, published, source FROM articles UNION ALL SELECT md5(url), url, url, DATE '2024-01-01', 'web' FROM pages)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY published, id) = 1""", "articles")
def _(t: Tables):
    web = t.raw("pages").select(F.md5("url").alias("id"), F.col("url").alias("title"), F.col("url").alias("link"),
                                F.lit("2024-01-01").cast("date").alias("published"), F.lit("web").alias("source"))
    both = t.articles.select("id", "title", "link", "published", "source").unionByName(web)
    first = both.groupBy(F.lower("title").alias("k")).agg(F.min_by(F.struct(*both.columns), F.struct("published", "id")).alias("r"))
    return first.select("r.*")


@query("intersect_dates", "SELECT date FROM bars INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem", "bars")
def _(t: Tables):
    return t.bars.select("date").intersect(t.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("date")))


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t: Tables):
    return t.raw("documents").select("doc_id").exceptAll(t.raw("labels").select("doc_id"))


@query("anti_delete", "SELECT id, title FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "articles")
def _(t: Tables):
    return t.articles.join(t.raw("labels").where("toxic = 1"), "doc_id", "left_anti").select("id", "title")
