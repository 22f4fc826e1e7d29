"""Return, volatility, drawdown and risk statistics per series.

Inputs are long: bars(symbol, date, close) or returns(symbol, date, ret).  Statistics that need only moments
are one mergeable ``groupBy``.  Quantiles are exact and work on one series at a time, which the calendar bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import interpolated, prev, product, rate, roll, running, running_product, series

WHOLE = "symbol"


def resample_last(df: DataFrame, unit: str = "month", col: str = "close") -> DataFrame:
    """Last value of each observed week (Monday to Sunday), month, quarter or year, and its change."""
    p = F.trunc("date", unit).alias("period")
    out = df.groupBy("symbol", p).agg(F.max_by(col, "date").alias("last"))
    return out.withColumn("ret", rate("last", 1, series(time="period")))


def resample_returns(df: DataFrame, unit: str = "month", method: str = "compound") -> DataFrame:
    if method not in ("compound", "sum"):
        raise ValueError(f"unknown method: {method}")
    agg = product(1 + F.col("ret")) - 1 if method == "compound" else F.sum("ret")
    return df.groupBy("symbol", F.trunc("date", unit).alias("period")).agg(agg.alias("ret"))


def performance_calendar(df: DataFrame) -> DataFrame:
    """Quarterly and yearly returns and month-end cumulative returns with period labels, in long form."""
    def part(unit, label):
        return resample_last(df, unit).where("ret IS NOT NULL").select(
            "symbol", F.lit(f"{unit}_return").alias("kind"), label.alias("label"), F.col("ret").alias("value"))

    y = F.year("period").cast("string")
    quarterly = part("quarter", F.concat(F.lit("Q"), F.quarter("period").cast("string"), F.lit(" "), y))
    yearly = part("year", y)
    first = F.min_by("first", "period").over(W.partitionBy("symbol"))
    month = df.groupBy("symbol", F.trunc("date", "month").alias("period")).agg(
        F.max_by("close", "date").alias("last"), F.min_by("close", "date").alias("first"))
    monthly = month.select("symbol", F.lit("month_cumulative").alias("kind"), F.date_format("period", "yyyy-MM").alias("label"),
                           (F.try_divide(F.col("last"), first) - 1).alias("value"))
    return quarterly.unionByName(yearly).unionByName(monthly)


def drawdowns(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Adds the compounded curve, its running peak and the fall from it; the peak starts after the first return."""
    df = df.withColumn("curve", running_product(1 + F.col(ret)))
    df = df.withColumn("peak", running(F.max, "curve"))
    return df.withColumn("drawdown", F.try_divide(F.col("curve"), F.col("peak")) - 1)


def analyze_returns(bars: DataFrame) -> DataFrame:
    df = bars.select("symbol", "date", "close", rate("close").alias("ret"))
    df = df.withColumn("_peak", F.max(F.when(F.col("ret").isNotNull(), F.col("close"))).over(
        series().rowsBetween(W.unboundedPreceding, 0)))
    r = F.col("ret")
    out = df.groupBy("symbol").agg(
        (F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("total_return"), F.avg(r).alias("daily_mean"),
        F.stddev_samp(r).alias("daily_std"), st.sharpe("ret").alias("sharpe_ratio"),
        (st.ratio(F.avg(r), F.stddev_samp(F.when(r < 0, r))) * math.sqrt(252)).alias("sortino_ratio"),
        F.min(F.try_divide(F.col("close"), F.col("_peak")) - 1).alias("max_drawdown"), F.count_if(r > 0).alias("positive_days"),
        F.count_if(r < 0).alias("negative_days"), F.count(r).alias("num_observations"))
    n = F.col("num_observations")
    return out.withColumns({
        "annualized_return": F.when(n > 0, F.pow(1 + F.col("total_return"), 252 / n) - 1).otherwise(0.0),
        "win_rate": st.ratio(F.col("positive_days").cast("double"), n)})


def analyze_volatility(bars: DataFrame, n: int = 21) -> DataFrame:
    df = bars.select("symbol", "date", rate("close").alias("ret"))
    df = df.withColumn("rv", roll(F.stddev_samp, "ret", n) * math.sqrt(252))
    df = df.withColumn("vv", rate("rv"))
    out = df.groupBy("symbol").agg(
        F.stddev_samp("ret").alias("daily_volatility"), F.max_by("rv", "date").alias("current_volatility"),
        (F.stddev_samp("vv") * math.sqrt(252)).alias("volatility_of_volatility"), st.sorted_values("rv").alias("_v"))
    out = out.withColumn("annualized_volatility", F.col("daily_volatility") * math.sqrt(252))
    return out.withColumns({f"volatility_{int(q * 100)}th": interpolated(F.col("_v"), q) for q in (0.25, 0.5, 0.75, 0.9)}).drop("_v")


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Worst fall of the compounded curve, as a positive number."""
    ret = bars.select("symbol", "date", rate("close").alias("ret")).where("ret IS NOT NULL")
    return drawdowns(ret).groupBy("symbol").agg((-F.min("drawdown")).alias("max_drawdown"))


def max_drawdown_dates(returns: DataFrame) -> DataFrame:
    """Worst fall with its peak, trough and recovery date."""
    whole = W.partitionBy("symbol")
    df = drawdowns(returns.select("symbol", "date", "ret"))
    df = df.withColumns({"_worst": F.min("drawdown").over(whole), "_last": F.max("date").over(whole)})
    df = df.withColumn("_end", F.min(F.when(F.col("drawdown") == F.col("_worst"), F.col("date"))).over(whole))
    df = df.withColumn("_top", F.max(F.when(F.col("date") <= F.col("_end"), F.col("curve"))).over(whole))
    at_top = (F.col("curve") == F.col("_top")) & (F.col("date") <= F.col("_end"))
    back = (F.col("date") >= F.col("_end")) & (F.col("curve") >= F.col("_top"))
    out = df.groupBy("symbol").agg(
        (-F.min("_worst")).alias("max_drawdown"), F.min(F.when(at_top, F.col("date"))).alias("drawdown_start"),
        F.min("_end").alias("drawdown_end"), F.min(F.when(back, F.col("date"))).alias("drawdown_recovery"), F.min("_last").alias("_last"))
    stop = F.coalesce("drawdown_recovery", "_last")
    return out.withColumns({"drawdown_duration": F.datediff(stop, "drawdown_start"),
                            "recovered": F.col("drawdown_recovery").isNotNull()}).drop("_last")


def drawdown_profile(returns: DataFrame) -> DataFrame:
    """Depth and run lengths of falls: islands of consecutive rows below the peak, by gaps in row numbers."""
    df = drawdowns(returns).withColumns({"_i": F.row_number().over(series()), "_under": F.col("drawdown") < 0})
    last = F.max("_i").over(W.partitionBy("symbol"))
    df = df.withColumns({"_island": F.col("_i") - F.sum(F.col("_under").cast("int")).over(series().rowsBetween(W.unboundedPreceding, 0)),
                         "_n": last})
    depth = df.groupBy("symbol").agg((F.min("drawdown") * 100).alias("max_drawdown"),
                                     st.zero_if_null(F.avg(F.when(F.col("_under"), F.col("drawdown") * 100))).alias("avg_drawdown"))
    runs = df.where("_under").groupBy("symbol", "_island").agg(F.count("*").alias("len"), (F.max("_i") == F.max("_n")).alias("open"))
    per = runs.groupBy("symbol").agg(F.avg("len").alias("avg_duration"), F.avg(F.when(~F.col("open"), F.col("len"))).alias("avg_recovery"))
    out = depth.join(per, "symbol", "left").na.fill(0.0, ["avg_duration", "avg_recovery"])
    return out.withColumn("recovery_ratio", st.ratio("avg_recovery", "avg_duration"))


def with_benchmark(returns: DataFrame, benchmark: DataFrame, min_rows: int = 1) -> DataFrame:
    """Common dates of each series with the benchmark, series with fewer common rows left out.

    The benchmark holds one row per date, so it is broadcast whatever the number of symbols.
    """
    b = F.broadcast(benchmark.select("date", F.col("ret").alias("bench")))
    df = returns.join(b, "date")
    n = F.count("*").over(W.partitionBy("symbol"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n").select("symbol", "date", "ret", "bench")


def beta(returns: DataFrame, benchmark: DataFrame, n: int = 252, min_rows: int = 30) -> DataFrame:
    """Slope on the last n common rows; zero for series with too few of them or a flat benchmark."""
    b = F.broadcast(benchmark.select("date", F.col("ret").alias("bench")))
    df = returns.join(b, "date", "left").select("symbol", "date", "ret", "bench")
    newest = W.partitionBy("symbol").orderBy(F.col("bench").isNull(), F.col("date").desc())
    df = df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    common = F.count("bench")
    slope = F.when(common >= min_rows, st.ratio(F.covar_samp("ret", "bench"), F.var_samp(F.when(F.col("ret").isNotNull(), F.col("bench")))))
    return df.groupBy("symbol").agg(F.coalesce(slope, F.lit(0.0)).alias("beta"), common.alias("n_common"))


def alpha(pairs: DataFrame, rf: float = 0.0, factor: int = 252) -> DataFrame:
    """Annualised excess mean over what beta explains, with beta beside it; rows (symbol, ret, bench)."""
    b = st.ratio(F.covar_samp("ret", "bench"), F.var_samp("bench"))
    p = rf / factor
    return pairs.groupBy("symbol").agg(b.alias("beta"), ((F.avg("ret") - (p + b * (F.avg("bench") - p))) * factor).alias("alpha"))


def value_at_risk(returns: DataFrame, level: float = 0.95, method: str = "historical", draws: int = 10000, seed: int = 42) -> DataFrame:
    """Loss at the confidence level, positive for a loss."""
    z = st.norm_ppf(1 - level)
    g = returns.groupBy("symbol")
    if method == "historical":
        return g.agg((-F.percentile("ret", 1 - level)).alias("var"))
    if method == "parametric":
        return g.agg((-(F.avg("ret") + z * F.stddev_samp("ret"))).alias("var"))
    if method == "cornish_fisher":
        a = abs(z)
        s, k = F.skewness("ret"), F.kurtosis("ret")
        cf = a + (a * a - 1) * s / 6 + (a**3 - 3 * a) * k / 24 - (2 * a**3 - 5 * a) * s * s / 36
        return g.agg((-(F.avg("ret") - cf * F.stddev_samp("ret"))).alias("var"))
    if method == "monte_carlo":
        return simulate(returns, draws, seed).select("symbol", st.var_of(F.col("draws"), level).alias("var"))
    raise ValueError(f"unknown method: {method}")


def simulate(returns: DataFrame, draws: int, seed: int) -> DataFrame:
    """Sorted normal draws per series with its mean and std: Box-Muller over row hashes, inside one row."""
    g = returns.groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    def uniform(i, tag):
        return (F.pmod(F.xxhash64("symbol", i, F.lit(seed), F.lit(tag)), F.lit(2**52)) + 0.5) / float(2**52)
    z = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.col("m") + F.col("s") * F.sqrt(
        -2 * F.ln(uniform(i, 1))) * F.cos(2 * math.pi * uniform(i, 2)))
    return g.select("symbol", F.array_sort(z).alias("draws"))


def expected_shortfall(returns: DataFrame, level: float = 0.95, method: str = "historical", draws: int = 10000, seed: int = 42) -> DataFrame:
    if method == "historical":
        values = returns.groupBy("symbol").agg(st.sorted_values("ret").alias("draws"))
    elif method == "parametric":
        z = st.norm_ppf(1 - level)
        return returns.groupBy("symbol").agg((-(F.avg("ret") - F.stddev_samp("ret") * st.norm_pdf(z) / (1 - level))).alias("cvar"))
    elif method == "monte_carlo":
        values = simulate(returns, draws, seed)
    else:
        raise ValueError(f"unknown method: {method}")
    values = values.withColumn("var", st.var_of(F.col("draws"), level))
    return values.select("symbol", "var", st.tail_mean(F.col("draws"), F.col("var")).alias("cvar"))


def tail_risk(returns: DataFrame, levels=(0.95, 0.99, 0.999)) -> DataFrame:
    r = F.col("ret")
    out = returns.groupBy("symbol").agg(
        F.count(r).cast("double").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"), st.sorted_values("ret").alias("_v"),
        F.count_if(r < 0).alias("_dn"), F.avg(F.when(r < 0, r)).alias("_down"), F.avg(F.when(r >= 0, r)).alias("_up"))
    tag = lambda p, q: f"{p}_{str(q)[2:]}"
    out = out.withColumns({tag("var", q): st.var_of(F.col("_v"), q) for q in levels})
    out = out.withColumns({tag("cvar", q): st.tail_mean(F.col("_v"), F.col(tag("var", q))) for q in levels})
    n, s, k = F.col("n"), F.col("skewness"), F.col("kurtosis")
    out = out.withColumns({"jarque_bera": n / 6 * (s * s + k * k / 4),
                           "omnibus": F.when(n >= 8, F.expr(st.omnibus_expr("n", "skewness", "kurtosis")))})
    both = (F.col("_dn") > 10) & (n - F.col("_dn") > 10)
    return out.withColumns({
        "jarque_bera_p": F.exp(-F.col("jarque_bera") / 2), "omnibus_p": F.exp(-F.col("omnibus") / 2),
        "down_to_normal_ratio": F.when(both, F.try_divide(F.col("_down"), F.col("_up")))}).drop("_v", "_dn", "_down", "_up")


def portfolio_statistics(returns: DataFrame, benchmark: DataFrame | None = None, rf: float = 0.0, period: str = "daily") -> DataFrame:
    """The full performance sheet of every series, with the benchmark part where one is given."""
    f = st.PERIODS[period]
    root = math.sqrt(f)
    r = F.col("ret")
    neg = F.when(r < 0, r)
    sheet = returns.groupBy("symbol").agg(
        (product(1 + r) - 1).alias("total_return"), F.count(r).alias("periods"),
        (F.stddev_samp(r) * root).alias("annualized_volatility"),
        (st.ratio(F.avg(r - rf / f), F.stddev_samp(r)) * root).alias("sharpe_ratio"),
        st.sortino_target("ret", rf, f).alias("sortino_ratio"), (F.stddev_samp(neg) * root).alias("downside_risk"),
        st.sorted_values("ret").alias("_v"), F.avg((r > 0).cast("double")).alias("positive_periods"),
        F.avg((r < 0).cast("double")).alias("negative_periods"), F.max(r).alias("best_period"), F.min(r).alias("worst_period"),
        st.sample_skew("ret").alias("skewness"), st.sample_kurtosis("ret").alias("kurtosis"))
    sheet = sheet.withColumns({
        "annualized_return": F.pow(1 + F.col("total_return"), f / F.col("periods")) - 1,
        "var_95": st.var_of(F.col("_v"), 0.95), "var_99": st.var_of(F.col("_v"), 0.99)})
    sheet = sheet.withColumns({"cvar_95": st.tail_mean(F.col("_v"), F.col("var_95")),
                               "return_risk_ratio": st.ratio("annualized_return", "annualized_volatility")}).drop("_v")
    sheet = sheet.join(max_drawdown_dates(returns), "symbol")
    if benchmark is None:
        return sheet
    a = F.col("ret") - F.col("bench")
    versus = with_benchmark(returns, benchmark).groupBy("symbol").agg(
        st.ratio(F.covar_samp("ret", "bench"), F.var_samp("bench")).alias("beta"), (product(1 + F.col("bench")) - 1).alias("_bt"),
        F.count("*").alias("_bn"), (F.try_divide(F.avg(a), F.stddev_samp(a)) * root).alias("information_ratio"),
        (F.stddev_samp(a) * root).alias("tracking_error"), F.corr("ret", "bench").alias("correlation"))
    out = sheet.join(versus, "symbol", "left")
    bench_annual = F.pow(1 + F.col("_bt"), f / F.col("_bn")) - 1
    return out.withColumns({
        "alpha": F.col("annualized_return") - (rf + F.col("beta") * (bench_annual - rf)),
        "r_squared": F.col("correlation") * F.col("correlation"),
        "treynor_ratio": st.ratio(F.col("annualized_return") - rf, "beta")}).drop("_bt", "_bn")


def portfolio_moments(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(
        F.avg("ret").alias("mean"), F.var_samp("ret").alias("variance"), F.stddev_samp("ret").alias("volatility"),
        F.skewness("ret").alias("skewness"), F.kurtosis("ret").alias("kurtosis"))


def sector_performance(returns: DataFrame) -> DataFrame:
    """Sheet per sector series (symbol = sector) and three rankings."""
    dd = drawdowns(returns)
    out = dd.groupBy("symbol").agg(F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"),
                                   F.min("drawdown").alias("max_drawdown"))
    out = out.withColumn("sharpe", st.ratio("mean_return", "volatility"))
    rank = lambda c: F.rank().over(W.partitionBy(F.lit(1)).orderBy(c))  # noqa: E731  one row per sector
    return out.withColumns({"rank_return": rank(F.desc("mean_return")), "rank_sharpe": rank(F.desc("sharpe")),
                            "rank_volatility": rank(F.asc("volatility"))})
