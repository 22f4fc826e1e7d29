"""Portfolio construction, attribution, stress and rebalancing.

Weights are rows (portfolio_id, symbol, weight); returns are rows (symbol, date, ret).  A missing return counts
as zero, which makes the covariance of an asset with its portfolio a single sum over the asset's own rows: the
risk split needs no covariance matrix and is linear in the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import product, running_product
from barloom.operators.statistics import drawdown_profile, drawdowns, expected_shortfall

PORT = ["portfolio_id"]


def normalize_weights(weights: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Scales each portfolio to sum one; an asset without a finite weight is an error."""
    if assets is not None:
        weights = assets.join(weights, [c for c in ("portfolio_id", "symbol") if c in assets.columns], "left")
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no finite weight for "), F.col("symbol").cast("string"))).cast("double")).otherwise(F.col("weight"))
    df = weights.withColumn("weight", checked)
    total = df.groupBy("portfolio_id").agg(F.sum("weight").alias("_t"))
    return df.join(total, "portfolio_id").withColumn("weight", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(F.col("weight"))).drop("_t")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    joined = returns.join(normalize_weights(weights), "symbol")
    return joined.groupBy("portfolio_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def as_series(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("portfolio_id", "symbol")


def portfolio_metrics(port: DataFrame) -> DataFrame:
    """Annual mean, volatility, Sharpe, worst fall and total return of portfolio return series."""
    dd = drawdowns(as_series(port).select("symbol", "date", "ret"))
    out = dd.groupBy(F.col("symbol").alias("portfolio_id")).agg(
        (F.avg("ret") * 252).alias("mean_return"), (F.stddev_samp("ret") * math.sqrt(252)).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"), (F.max_by("curve", "date") - 1).alias("total_return"))
    return out.withColumn("sharpe_ratio", st.ratio("mean_return", "volatility"))


def portfolio_risk(returns: DataFrame, weights: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Volatility, betas, marginal, component and percent contributions and diversification ratio.

    ``market`` (date, ret) defaults to the first symbol's returns.
    """
    w = normalize_weights(weights)
    if market is None:
        first = w.agg(F.min("symbol")).scalar()
        market = returns.where(F.col("symbol") == first).select("date", "ret")
    joined = returns.join(w, "symbol")
    port = joined.groupBy("portfolio_id", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("p"))
    days = port.groupBy("portfolio_id").agg(F.count("*").alias("d"), F.sum("p").alias("sp"), F.var_samp("p").alias("vp"))
    m = F.broadcast(market.select("date", F.col("ret").alias("m")))  # one row per date
    sums = market.agg(F.struct(F.sum("ret").alias("sm"), F.sum(F.col("ret") * F.col("ret")).alias("smm"))).scalar()
    rows = joined.join(port, ["portfolio_id", "date"]).join(m, "date", "left")
    r = F.col("ret")
    per = rows.groupBy("portfolio_id", "symbol").agg(
        F.max("weight").alias("weight"), F.sum(r).alias("sr"), F.sum(r * r).alias("srr"), F.sum(r * F.col("p")).alias("srp"),
        F.sum(r * F.coalesce("m", F.lit(0.0))).alias("srm"))
    per = per.withColumn("_m", sums).withColumns({"sm": F.col("_m.sm"), "smm": F.col("_m.smm")}).drop("_m")
    per = per.join(days, "portfolio_id")
    d = F.col("d")
    cov = lambda xy, x, y: F.try_divide(F.col(xy) - F.col(x) * F.col(y) / d, d - 1)
    vol = F.nullif(F.sqrt(F.col("vp") * 252), F.lit(0.0))
    per = per.withColumns({"volatility": vol, "beta": F.try_divide(cov("srm", "sr", "sm"), cov("smm", "sm", "sm")),
                           "marginal_contribution": cov("srp", "sr", "sp") * 252 / vol, "asset_volatility": F.sqrt(cov("srr", "sr", "sr") * 252)})
    per = per.withColumn("component_contribution", F.col("weight") * F.col("marginal_contribution"))
    per = per.withColumn("percent_contribution", F.col("component_contribution") / F.col("volatility") * 100)
    spread = per.groupBy("portfolio_id").agg((F.sum(F.col("weight") * F.col("asset_volatility")) / F.max("volatility")).alias("diversification_ratio"))
    return per.join(spread, "portfolio_id").select(
        "portfolio_id", "symbol", "weight", "beta", "marginal_contribution", "component_contribution", "percent_contribution",
        "volatility", "diversification_ratio")


def portfolio_risk_report(returns: DataFrame, weights: DataFrame, market: DataFrame | None = None) -> DataFrame:
    port = as_series(portfolio_returns(returns, weights))
    risk = portfolio_risk(returns, weights, market).groupBy(F.col("portfolio_id").alias("symbol")).agg(
        F.max("volatility").alias("volatility"), F.max("diversification_ratio").alias("diversification_ratio"))
    tail = expected_shortfall(port).withColumnsRenamed({"var": "var_95", "cvar": "cvar_95"})
    dd = drawdown_profile(port).select("symbol", "max_drawdown", "avg_drawdown", F.col("avg_duration").alias("drawdown_duration"))
    return risk.join(tail, "symbol").join(dd, "symbol").withColumnRenamed("symbol", "portfolio_id")


# Shock per scenario by words in the asset name, first match wins, last entry without words.
SCENARIOS = {
    "market_crash": [(("bond",), -0.05), ((), -0.15)],
    "inflation_spike": [(("bond", "treasury"), -0.10), ((), 0.05)],
    "tech_bubble": [(("tech",), -0.25), ((), -0.05)],
    "recession": [(("equity",), -0.20), (("bond",), 0.05), ((), -0.10)],
}


def _shock(rules, name: Column) -> Column:
    value = None
    for words, shock in reversed(rules):
        if not words:
            value = F.lit(shock)
        else:
            hit = F.lower(name).rlike("|".join(words))
            value = F.when(hit, shock).otherwise(value)
    return value


def scenario_stress(weights: DataFrame, names: DataFrame, scenarios=None) -> DataFrame:
    """Impact in percent per scenario and the asset with the largest absolute shock (lowest symbol on ties)."""
    rules = scenarios or SCENARIOS
    df = weights.join(names.select("symbol", "name"), "symbol")
    shocks = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), _shock(v, F.col("name")).alias("shock")) for k, v in rules.items()]))
    df = df.select("portfolio_id", "symbol", "weight", shocks.alias("s")).select("portfolio_id", "symbol", "weight", "s.scenario", "s.shock")
    worst = F.max(F.struct(F.abs("shock").alias("size"), (-F.col("symbol")).alias("order"), "symbol", "shock"))
    return df.groupBy("portfolio_id", "scenario").agg(
        (F.sum(F.col("weight") * F.col("shock")) * 100).alias("portfolio_impact"), worst.alias("w")).select(
        "portfolio_id", "scenario", "portfolio_impact", F.col("w.symbol").alias("worst_asset"), F.col("w.shock").alias("worst_shock"))


def historical_stress(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Impact if every asset had its own worst, or best, day at once."""
    days = returns.groupBy("symbol").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    return weights.join(days, "symbol").groupBy("portfolio_id").agg(
        (F.sum(F.col("weight") * F.col("lo")) * 100).alias("worst_day_impact"),
        (F.sum(F.col("weight") * F.col("hi")) * 100).alias("best_day_impact"))


def factor_stress(returns: DataFrame, factors: dict[str, float], level: float = 0.95) -> DataFrame:
    """Value at risk, Sharpe and volatility of returns scaled per scenario; scaling is applied to the aggregates."""
    base = returns.groupBy("symbol").agg(st.sorted_values("ret").alias("v"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(f)).alias("f")) for k, f in factors.items()]))
    df = base.select("*", rows.alias("x")).select("symbol", "v", "m", "s", "x.scenario", "x.f")
    f = F.col("f")
    low, high = st.var_of(F.col("v"), level), st.var_of(F.col("v"), 1 - level)
    return df.select("symbol", "scenario", F.when(f >= 0, low * f).otherwise(high * f).alias("var"),
                     (st.ratio(F.col("m") * f, F.col("s") * F.abs(f)) * math.sqrt(252)).alias("sharpe"),
                     (F.col("s") * F.abs(f) * math.sqrt(252)).alias("volatility"))


def attribution(weights: DataFrame, totals: DataFrame) -> DataFrame:
    """Weight times return and its share of the portfolio return; ``totals`` holds (symbol, ret)."""
    df = weights.join(totals, "symbol", "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    df = df.withColumn("contribution", F.col("weight") * F.col("ret"))
    total = df.groupBy("portfolio_id").agg(F.sum("contribution").alias("total_return"))
    return df.join(total, "portfolio_id").withColumn("attribution", st.ratio("contribution", "total_return"))


def self_assess_benchmark(pairs: DataFrame) -> DataFrame:
    """Sheet of portfolio and benchmark on common dates, with alpha, beta and population tracking error."""
    p, b = F.col("ret"), F.col("bench")
    out = pairs.groupBy("symbol").agg(
        (product(1 + p) - 1).alias("total_return"), st.sharpe("ret").alias("sharpe"), (product(1 + b) - 1).alias("benchmark_return"),
        st.sharpe("bench").alias("benchmark_sharpe"), st.ratio(F.covar_samp("ret", "bench"), F.var_samp("bench")).alias("beta"),
        F.avg(p).alias("_m"), F.avg(b).alias("_b"), F.stddev_pop(p - b).alias("tracking_error"))
    return out.withColumn("alpha", (F.col("_m") - F.col("beta") * F.col("_b")) * 252).drop("_m", "_b").withColumnRenamed("symbol", "portfolio_id")


def rebalance_outer(targets: DataFrame, current: DataFrame) -> DataFrame:
    """Target weights and current values side by side, a missing side as zero."""
    df = targets.select("symbol", F.col("weight").alias("target_weight")).join(
        current.select("symbol", F.col("value").alias("current_value")), "symbol", "full")
    return df.na.fill(0.0, ["target_weight", "current_value"])


def rebalance_trades(targets: DataFrame, current: DataFrame, min_trade: float = 100.0) -> DataFrame:
    total = current.agg(F.sum("value")).scalar()
    df = rebalance_outer(targets, current).withColumn("_t", total)
    df = df.withColumns({"trade": F.col("_t") * F.col("target_weight") - F.col("current_value"),
                         "current_weight": F.col("current_value") / F.col("_t")})
    return df.where(F.abs("trade") >= min_trade).drop("_t")


def rebalance_actions(current: DataFrame, targets: DataFrame, band: float = 0.01) -> DataFrame:
    df = current.select("symbol", F.col("weight").alias("current")).join(
        targets.select("symbol", F.col("weight").alias("target")), "symbol", "left").na.fill(0.0, ["target"])
    df = df.withColumn("difference", F.col("target") - F.col("current")).where(F.abs("difference") > band)
    return df.withColumns({"action": F.when(F.col("difference") > 0, "buy").otherwise("sell"), "amount": F.abs("difference")})


# Target volatility per risk label.
TARGET_VOLATILITY = {"low": 0.10, "moderate": 0.15, "high": 0.20}


def recommend_equal(returns: DataFrame, risk: str = "moderate") -> DataFrame:
    """Equal weights over all symbols with the metrics they would have had."""
    symbols = returns.select("symbol").distinct()
    w = symbols.select(F.lit(1).alias("portfolio_id"), "symbol").withColumn("weight", 1.0 / symbols.agg(F.count("*")).scalar())
    metrics = portfolio_metrics(portfolio_returns(returns, w))
    extra = {"risk_tolerance": F.lit(risk), "target_volatility": F.lit(TARGET_VOLATILITY.get(risk, 0.20)),
             "weight": w.agg(F.max("weight")).scalar(), "assets": symbols.agg(F.count("*")).scalar()}
    return metrics.drop("portfolio_id").withColumns(extra)


def assess_scores(weights: DataFrame, metrics: DataFrame) -> DataFrame:
    """Diversification, risk and overall scores with their messages."""
    per = weights.groupBy("portfolio_id").agg(F.count_if(F.col("weight") > 0.01).alias("asset_count"), F.max("weight").alias("max_weight"))
    df = per.join(metrics.select("portfolio_id", "volatility", "max_drawdown"), "portfolio_id")
    few, packed = F.col("asset_count") < 5, F.col("max_weight") > 0.25
    hot, deep = F.col("volatility") > 0.25, F.col("max_drawdown") < -0.25
    df = df.withColumns({"diversification_score": F.when(few, 3).when(packed, 5).otherwise(8),
                         "risk_score": F.when(hot, 3).when(deep, 4).otherwise(7), "liquidity_score": F.lit(0)})
    advice = F.array_compact(F.array(
        F.when(few, "Too few assets: spread the money over more of them").when(
            packed, "One position outweighs the rest: trim it"),
        F.when(hot, "Prices swing widely: hold calmer assets").when(
            deep, "Past falls were deep: hedge or hold more cash")))
    overall = (F.col("diversification_score") + F.col("risk_score") + F.col("liquidity_score")) / 3
    return df.withColumns({"overall_score": overall, "recommendations": F.array_join(advice, "; ")})


def exposures(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Normalised weight by sector and by asset class; unknown symbols under 'Unknown'."""
    df = normalize_weights(weights).join(labels.select("symbol", "sector", "asset_class"), "symbol", "left")
    df = df.na.fill("Unknown", ["sector", "asset_class"])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("sector", "asset_class")]))
    return df.select("portfolio_id", "weight", kinds.alias("k")).groupBy("portfolio_id", "k.kind", "k.label").agg(F.sum("weight").alias("exposure"))


def exposure_limits(exposure: DataFrame, over: float = 0.4, under: float = 0.05) -> DataFrame:
    e = F.col("exposure")
    status = F.when(e > over, "over").when(e < under, "under")
    return exposure.withColumn("status", status).where(F.col("status").isNotNull())


def allocation(holdings: DataFrame, labels: DataFrame) -> DataFrame:
    """Percent of value by symbol, sector and asset class."""
    df = holdings.select("symbol", (F.col("quantity") * F.col("current_price")).alias("value")).join(labels.select("symbol", "sector", "asset_class"), "symbol", "left")
    kinds = F.explode(F.array(F.struct(F.lit("symbol").alias("kind"), F.col("symbol").cast("string").alias("label")),
                              F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("label")),
                              F.struct(F.lit("asset_class").alias("kind"), F.col("asset_class").alias("label"))))
    total = df.agg(F.sum("value")).scalar()
    out = df.select("value", kinds.alias("k")).groupBy("k.kind", "k.label").agg(F.sum("value").alias("value"))
    return out.withColumn("share", F.col("value") / total * 100)


def holdings_pnl(holdings: DataFrame, as_of: Column) -> DataFrame:
    """Cost, value and gain per position with a total row (symbol null)."""
    df = holdings.withColumns({"cost_basis": F.col("quantity") * F.col("purchase_price"),
                               "current_value": F.col("quantity") * F.col("current_price"),
                               "days_held": F.datediff(as_of, "purchase_date")})
    per = df.select("symbol", "cost_basis", "current_value", "days_held")
    total = per.agg(F.lit(None).cast(dict(per.dtypes)["symbol"]).alias("symbol"), F.sum("cost_basis").alias("cost_basis"),
                    F.sum("current_value").alias("current_value"), F.lit(None).cast("int").alias("days_held"))
    both = per.unionByName(total).withColumn("gain_loss", F.col("current_value") - F.col("cost_basis"))
    return both.withColumn("gain_loss_pct", F.when(F.col("cost_basis") > 0, F.col("gain_loss") / F.col("cost_basis") * 100).otherwise(0.0))


FREQUENCIES = ["annual", "semi_annual", "quarterly", "monthly"]


def dividend_income(holdings: DataFrame) -> DataFrame:
    """Annual income per position."""
    income = F.col("dividend_yield") / 100 * F.col("current_price") * F.col("quantity")
    return holdings.select("symbol", "quantity", "current_price", "dividend_yield", F.coalesce("frequency", F.lit("quarterly")).alias("frequency"), income.alias("annual_income"))


def dividend_summary(holdings: DataFrame) -> DataFrame:
    """Total income, income by payment frequency and portfolio yield."""
    df = dividend_income(holdings)
    v = F.sum(F.col("quantity") * F.col("current_price"))
    return df.agg(F.sum("annual_income").alias("total_annual_income"),
                  *[st.zero_if_null(F.sum(F.when(F.col("frequency") == k, F.col("annual_income")))).alias(f"income_{k}") for k in FREQUENCIES],
                  (F.sum("annual_income") / v * 100).alias("portfolio_yield"))


def cumulative_vs_benchmark(port: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Cumulative return of each portfolio and of the benchmark, and the portfolio's running fall."""
    b = F.broadcast(benchmark.select("date", F.col("ret").alias("bench")))  # one row per date
    df = drawdowns(as_series(port).join(b, "date", "left").na.fill(0.0, ["bench"]))
    df = df.withColumn("benchmark_cumulative", running_product(1 + F.col("bench")) - 1)
    return df.select(F.col("symbol").alias("portfolio_id"), "date", (F.col("curve") - 1).alias("cumulative"), "benchmark_cumulative", "drawdown")


def predicted_portfolio(weights: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Weighted current and predicted value; ``forecasts`` holds (symbol, current_price, predicted_price)."""
    df = weights.join(forecasts, "symbol")
    out = df.groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("current_price")).alias("current_value"),
                                         F.sum(F.col("weight") * F.col("predicted_price")).alias("predicted_value"))
    return out.withColumn("predicted_return", st.ratio(F.col("predicted_value") - F.col("current_value"), "current_value"))


def capital_market_line(best: DataFrame, rf: float = 0.0, points: int = 50) -> DataFrame:
    """Mix of cash and the best-Sharpe portfolio of ``optimizer.weight_search`` for volatilities from zero to twice its own."""
    top = best.where(F.col("objective") == "sharpe")
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    df = top.select("expected_return", F.col("volatility").alias("_v"), step)
    df = df.withColumn("volatility", F.col("_v") * 2 * F.col("i") / (points - 1))
    share = F.col("volatility") / F.col("_v")
    return df.select("i", (rf + (F.col("expected_return") - rf) * share).alias("expected_return"), "volatility",
                     share.alias("risky_allocation"), (1 - share).alias("risk_free_allocation"))
