"""Series operators against pandas and hand-made values."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from barloom.functions import stats as st
from barloom.functions.frames import ewm_many
from barloom.functions.order import exact_quantiles, with_row_index
from barloom.operators import anomalies, features, forecast, indicators, optimizer, pairs, peers, signals, statistics
from barloom.operators import portfolio as pf
from barloom.plans import load_all
from barloom.registry import REGISTRY
from barloom.sources.readers import materialize
from pyspark.sql import functions as F

DAY0 = datetime.date(1960, 1, 1)


def frame(spark, values: dict, cols=("close",)):
    """{symbol: list of numbers or tuples} to (symbol, date, *cols)."""
    rows = [(s, DAY0 + datetime.timedelta(days=i), *(v if isinstance(v, tuple) else (float(v),))) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in cols))


def ordered(df, *cols):
    return df.orderBy("symbol", "date").select(*cols).toPandas()


def bars(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for s in ("A", "B"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        out[s] = [(float(x * 0.99), float(x * 1.02), float(x * 0.97), float(x), float(rng.integers(1, 50))) for x in c]
    return frame(spark, out, ("open", "high", "low", "close", "volume")).withColumn("volume", F.col("volume").cast("bigint"))


def test_ewm_matches_pandas_over_many_blocks(spark):
    x = 100 + np.cumsum(np.random.default_rng(0).normal(0, 1, 6000))
    df = ewm_many(frame(spark, {"A": x.tolist()}), [("close", n, f"e{n}") for n in (1, 2, 3, 12, 26, 200)])
    got = ordered(df, "*")
    for n in (1, 2, 3, 12, 26, 200):
        want = pd.Series(x).ewm(span=n, adjust=False).mean()
        assert np.allclose(got[f"e{n}"], want, rtol=1e-11), n


def test_adjusted_ewm(spark):
    x = np.random.default_rng(0).normal(100, 5, 3000)
    got = ordered(indicators.ema_adjusted(frame(spark, {"A": x.tolist()}), 10), "ema_adj_10")
    assert np.allclose(got["ema_adj_10"], pd.Series(x).ewm(span=10).mean(), rtol=1e-11)


def test_indicator_edges(spark):
    flat = frame(spark, {"A": [(5.0,) * 4 + (1.0,)] * 40}, ("open", "high", "low", "close", "volume")).withColumn("volume", F.col("volume").cast("bigint"))
    got = ordered(indicators.all_indicators(flat), "*")
    assert got["rsi_14"].isna().all() and got["stoch_k"].isna().all() and got["bb_percent_b"].isna().all() and got["adx"].isna().all()
    assert (got["obv"] == 0).all() and (got["macd_line"].abs() < 1e-12).all()
    rising = frame(spark, {"A": [(float(i), i + 1.0, i - 1.0, float(i), 1.0) for i in range(1, 40)]}, ("open", "high", "low", "close", "volume"))
    assert ordered(indicators.rsi(rising), "rsi_14")["rsi_14"].dropna().eq(100).all()
    assert ordered(indicators.rsi(rising), "rsi_14")["rsi_14"].first_valid_index() == 13
    for bad in (lambda: indicators.macd(rising, 26, 12), lambda: indicators.sma(rising, 0), lambda: indicators.bollinger(rising, 20, 0)):
        with pytest.raises(ValueError):
            bad()


def test_all_indicators_equal_single_ones(spark):
    b = bars(spark)
    wide = ordered(indicators.all_indicators(b), "*")
    for fn, cols in ((indicators.bollinger, ["bb_upper", "bb_percent_b", "bb_bandwidth"]), (indicators.adx, ["adx", "pos_di"]), (indicators.keltner, ["keltner_upper"]),
                     (indicators.ichimoku, ["senkou_span_b", "chikou_span"]), (indicators.stochastic, ["stoch_d"]), (indicators.macd, ["macd_histogram"])):
        one = ordered(fn(b), *cols)
        for c in cols:
            assert np.allclose(wide[c], one[c], rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_small_exact_values(spark):
    up = frame(spark, {"A": [100, 110, 121]})
    r = statistics.analyze_returns(up).first()
    assert math.isclose(r["total_return"], 0.21) and r["positive_days"] == 2 and r["win_rate"] == 1.0
    assert math.isclose(statistics.max_drawdown(frame(spark, {"A": [100, 80, 120, 60]})).first()["max_drawdown"], 0.5)
    assert signals.momentum(up).first()["momentum"] == 0
    rets = frame(spark, {"A": [0.1, -0.1, 0.2]}, ("ret",))
    assert math.isclose(statistics.value_at_risk(rets, 0.95).first()["var"], 0.08)
    w = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "portfolio_id int, symbol string, weight double")
    tot = spark.createDataFrame([("A", 0.2), ("B", 0.1)], "symbol string, ret double")
    got = {x["symbol"]: x["attribution"] for x in pf.attribution(w, tot).collect()}
    assert math.isclose(got["A"], 2 / 3) and math.isclose(got["B"], 1 / 3)


def test_weights_without_value_fail(spark):
    w = spark.createDataFrame([(1, "A", 0.5), (1, "B", float("nan"))], "portfolio_id int, symbol string, weight double")
    with pytest.raises(Exception, match="no finite weight"):
        pf.normalize_weights(w).collect()


def test_rebalance_missing_sides(spark):
    t = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "symbol string, weight double")
    c = spark.createDataFrame([("B", 600.0), ("C", 400.0)], "symbol string, value double")
    got = {r["symbol"]: r["trade"] for r in pf.rebalance_trades(t, c).collect()}
    assert got == {"A": 500.0, "B": -100.0, "C": -400.0}


def test_monte_carlo_is_near_parametric(spark):
    r = np.random.default_rng(3).normal(0.001, 0.02, 500)
    df = frame(spark, {"A": r.tolist()}, ("ret",))
    for fn, col in ((statistics.value_at_risk, "var"), (statistics.expected_shortfall, "cvar")):
        a, b = fn(df, method="monte_carlo").first()[col], fn(df, method="parametric").first()[col]
        assert abs(a - b) < 0.002


def test_pearson_p_value(spark):
    df = spark.createDataFrame([(0.5, 10), (0.0, 10), (0.9, 5), (-0.9, 5)], "correlation double, n int")
    got = [r["p_value"] for r in st.pearson_p(df).collect()]
    assert np.allclose(got, [0.14111328, 1.0, 0.03738607, 0.03738607], atol=1e-6)


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_pairwise_over_blocks(spark, method):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 0.02, (30, 12)) + rng.normal(0, 0.01, (30, 1))
    m[rng.random(m.shape) < 0.2] = np.nan
    names = [f"S{i:02d}" for i in range(12)]
    rows = [(names[j], DAY0 + datetime.timedelta(days=i), float(m[i, j])) for i in range(30) for j in range(12) if np.isfinite(m[i, j])]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double")
    got = {(r["symbol_a"], r["symbol_b"]): r["correlation"] for r in pairs.pairwise(df, "ret", 25, method, block=4).collect()}
    x = pd.DataFrame(m[-25:], columns=names)
    assert len(got) == 66
    for (a, b), v in got.items():
        both = x[[a, b]].dropna()
        if method == "kendall":
            p, q = both[a].to_numpy(), both[b].to_numpy()
            want = (np.sign(p[:, None] - p) * np.sign(q[:, None] - q)).sum() / (len(p) * (len(p) - 1))
        else:
            both = both.rank() if method == "spearman" else both
            want = both.corr().iloc[0, 1]
        assert abs(v - want) < 1e-9


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_pairwise_ties_and_tiles(spark, method, monkeypatch):
    """Equal values, a constant, an empty and an infinite series, a null symbol; blocks and tiles that hold a few series each."""
    monkeypatch.setattr(pairs, "SPREAD", 3)
    monkeypatch.setattr(pairs, "LARGEST", 4)
    monkeypatch.setattr(pairs, "METHODS", {k: (fn, 3) for k, (fn, _) in pairs.METHODS.items()})
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(0, 1, (20, 15)), 0)
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:, 3], m[:, 4], m[2, 5] = 2.0, np.nan, np.inf
    rows = [(None if j == 14 else j, DAY0 + datetime.timedelta(days=i), float(m[i, j])) for i in range(20) for j in range(15) if not np.isnan(m[i, j])]
    df = spark.createDataFrame(rows, "symbol int, date date, ret double")
    out = pairs.pairwise(df, "ret", 20, method, block=2, measures=("n", "correlation"))
    assert out.columns == ["symbol_a", "symbol_b", "n", "correlation"] and out.rdd.getNumPartitions() == 10
    got = {(r["symbol_a"], r["symbol_b"]): (r["n"], r["correlation"]) for r in out.collect() if None not in (r["symbol_a"], r["symbol_b"])}
    x = pd.DataFrame(m)
    want = {}
    for a in range(14):
        for b in range(a + 1, 14):
            both = x[[a, b]].dropna()
            if 5 in (a, b) or not len(both):
                continue
            if method == "kendall":
                p, q = (np.sign(both[c].to_numpy()[:, None] - both[c].to_numpy()) for c in (a, b))
                with np.errstate(all="ignore"):
                    r = (p * q).sum() / np.sqrt(abs(p).sum() * abs(q).sum())
            else:
                both = both.rank() if method == "spearman" else both
                r = both[a].corr(both[b])
            want[a, b] = len(both), None if np.isnan(r) else r
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-9)


def test_pair_self_join_counts_all_dates(spark, tmp_path):
    """Common dates far older than the newest 252 count, and so do pairs that share no newer one."""
    days = [DAY0 + datetime.timedelta(days=i) for i in range(400)]
    traded = {1: range(400), 2: range(0, 400, 3), 3: range(30)}
    spark.createDataFrame([(i, str(d)) for i, d in enumerate(days)], "o_orderkey long, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(i, 1, s, 1.0, 100.0 + i + s, 0.0, 0.0) for s, at in traded.items() for i in at]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    load_all()
    got = {(r["symbol_a"], r["symbol_b"]): r["n"] for r in REGISTRY["pair_self_join"].run(spark, str(tmp_path)).collect()}
    # a series has no return on its first date
    assert got == {(1, 2): 133, (1, 3): 29, (2, 3): 9}


def test_pairwise_stores_and_copies_no_more_than_it_needs(spark, monkeypatch):
    """Dates and values are stored once, counts copy no values, and a block holds a bounded number of them."""
    stored = []
    monkeypatch.setattr(pairs, "materialize", lambda df, name: stored.append((name, df.columns)) or materialize(df, name))
    rows = [(f"S{i}", DAY0 + datetime.timedelta(days=d), v, "x") for i in range(6) for d, v in enumerate([0.1 * i, 0.2, None if i == 2 else 0.3, math.inf if i == 3 else 0.4])]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double, other string")
    got = {(r["symbol_a"], r["symbol_b"]): r["n"] for r in pairs.pairwise(df, "ret", None, measures=("n",)).collect()}
    assert got == {(f"S{a}", f"S{b}"): 3 if a == 2 or b == 2 else 4 for a in range(6) for b in range(a + 1, 6) if 3 not in (a, b)}
    assert stored == [("values", ["symbol", "date", "v"]), ("series", ["symbol", "c"])]
    monkeypatch.setattr(pairs, "CELLS", 2 * 8 * 4)
    few = pairs.pairwise(df, "ret", 4, block=2)
    assert few.rdd.getNumPartitions() == 6  # three blocks of two series
    assert {(r["symbol_a"], r["symbol_b"]): r["n"] for r in few.collect()} == got


def test_exact_quantiles_with_narrow_brackets_and_ties(spark):
    x = np.concatenate([np.random.default_rng(2).lognormal(0, 3, 30000), np.full(15000, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"v": x, "w": -x})).repartition(8)
    got = {(r["name"], r["q"]): r["value"] for r in exact_quantiles(df, ["v", "w"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], accuracy=1000).collect()}
    for (c, q), v in got.items():
        assert math.isclose(v, np.quantile(x if c == "v" else -x, q), rel_tol=1e-12), (c, q)


def test_exact_quantiles_by_rounds(spark):
    """One value that fills the column, values sorted by partition, a coarse sketch and small leaves."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.full(1_000_000, 3.5), rng.normal(0, 1, 40_000), 10.0 ** rng.uniform(-300, 300, 20_000), [-np.inf, np.inf, np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"v": np.sort(x), "none": np.nan}))
    qs, finite = [0.0, 0.001, 0.01, 0.03, 0.5, 0.985, 0.99, 0.9999, 1.0], x[~np.isnan(x)]
    for accuracy, leaf in ((100, 1), (10_000, 1 << 16)):
        got = {r["q"]: r["value"] for r in exact_quantiles(df, ["v", "none"], qs, accuracy, leaf).collect()}
        assert set(got) == set(qs)
        for q, v in got.items():
            want = np.sort(finite)[int((len(finite) - 1) * q)] if q in (0.0, 1.0) else np.quantile(finite, q)
            assert v == want or math.isclose(v, want, rel_tol=1e-9), (q, v, want)
    assert exact_quantiles(df.limit(0), ["v"], qs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 399, 401, 1234, 5321])
def test_exact_quantiles_of_short_columns(spark, n):
    x = np.random.default_rng(n).normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(3)
    got = {r["q"]: r["value"] for r in exact_quantiles(df, ["v"], [0.01, 0.25, 0.5, 0.75, 0.999]).collect()}
    for q, v in got.items():
        assert math.isclose(v, np.quantile(x, q), rel_tol=1e-12, abs_tol=1e-12), (n, q)


def test_row_index_with_hot_first_key(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in zip(np.where(rng.random(5000) < 0.4, 3.0, rng.integers(0, 900, 5000)), rng.permutation(5000))]
    got = with_row_index(spark.createDataFrame(rows, "a double, b double").repartition(6), "a", ["b"], size=200).toPandas().sort_values(["a", "b"])
    assert got["row_index"].tolist() == list(range(5000))


def lof_brute(series, k):
    """Factors of (date, value) pairs: neighbours by distance, then date, among the k next lower and higher values."""
    ordered = sorted((v, d) for d, v in series)
    near = {}
    for i, (v, d) in enumerate(ordered):
        others = ordered[max(i - k, 0):i] + ordered[i + 1:i + k + 1]
        near[d] = sorted((abs(w - v), e) for w, e in others)[:k]
    kd = {d: max((x for x, _ in ns), default=0.0) for d, ns in near.items()}
    lrd = {d: 1 / (sum(max(x, kd[e]) for x, e in ns) / len(ns) + 1e-10) for d, ns in near.items() if ns}
    return {d: sum(lrd[e] for _, e in ns) / len(ns) / lrd[d] if ns else None for d, ns in near.items()}


def test_lof_of_many_series_as_array_steps(spark, monkeypatch):
    """Short and long series, equal values and single rows, cut by batches and pieces; no list of a frame is collected per row."""
    monkeypatch.setattr(anomalies, "ROWS", 40)
    monkeypatch.setattr(anomalies, "FRAMES", 16)
    rng = np.random.default_rng(21)
    kinds = [lambda n: rng.normal(100, 3, n), lambda n: np.round(rng.normal(0, 1, n), 1), lambda n: rng.integers(0, 3, n).astype(float)]
    series = {s: [(DAY0 + datetime.timedelta(days=int(d)), float(v)) for d, v in enumerate(kinds[s % 3](n))] for s, n in enumerate([1, 2, 5, 30, 90, 90, 150, 11, 12])}
    df = spark.createDataFrame([(s, d, v, f"{s}/{d}") for s, rows in series.items() for d, v in rows], "symbol int, date date, close double, tag string").repartition(3)
    out = anomalies.lof(df, k=5, contamination=0.1)
    assert out.columns == ["symbol", "date", "close", "tag", "lof", "is_anomaly"] and "collect_list" not in out._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {(r["symbol"], r["date"]): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, series.values())) and all(r["tag"] == f"{s}/{d}" for (s, d), r in got.items())
    for s, rows in series.items():
        want = lof_brute(rows, 5)
        known = [x for x in want.values() if x is not None]
        cut = np.quantile(known, 0.9) if known else math.inf
        for d, x in want.items():
            r = got[s, d]
            assert (r["lof"] is None) if x is None else math.isclose(r["lof"], x, rel_tol=1e-9)
            assert r["is_anomaly"] == int(x is not None and x > cut) or math.isclose(x, cut, rel_tol=1e-9)


def test_lof_of_missing_values_and_days(spark):
    """A row without a day has no neighbours and is none; rows of one day are no neighbours of each other; missing values keep their rows."""
    day = [DAY0 + datetime.timedelta(days=i) for i in range(6)]
    rows = [("A", day[0], 1.0), ("A", day[1], 2.0), ("A", day[2], 4.0), ("A", None, 3.0), ("B", day[0], 1.0), ("B", day[0], 5.0), ("C", day[0], None), ("C", day[1], 1.0), ("C", day[2], 1.5)]
    got = {(r["symbol"], r["date"], r["close"]): r["lof"] for r in anomalies.lof(spark.createDataFrame(rows, "symbol string, date date, close double"), k=2).collect()}
    assert got["A", None, 3.0] is None and got["B", day[0], 1.0] is None and got["B", day[0], 5.0] is None and len(got) == 9
    assert np.allclose([got["A", day[0], 1.0], got["A", day[1], 2.0], got["A", day[2], 4.0]], [4 / 3, 3 / 4, 4 / 3])


def test_lof_matches_brute_force(spark):
    x = np.random.default_rng(6).normal(100, 10, 80)
    got = ordered(anomalies.lof(frame(spark, {"A": x.tolist()}), k=5), "lof")["lof"]
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    kd = np.sort(d, axis=1)[:, 4]
    lrd = 1 / (np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(1) + 1e-10)
    assert np.allclose(got, lrd[near].mean(1) / lrd, rtol=1e-9)


def least(cov, mu, appetite):
    """Weights of least variance / 2 - appetite * mean, by pairwise exchanges down to rounding."""
    w, g = np.full(len(mu), 1 / len(mu)), None
    for _ in range(20_000):
        g = cov @ w - appetite * mu
        i, held = int(g.argmin()), np.flatnonzero(w > 0)
        j = held[g[held].argmax()]
        if g[j] - g[i] < 1e-16:
            break
        t = min(w[j], (g[j] - g[i]) / max(cov[i, i] + cov[j, j] - 2 * cov[i, j], 1e-300))
        w[i], w[j] = w[i] + t, w[j] - t
    return w


def test_frontier_matches_exchanges(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(0.001, 0.02, (80, 7)) * np.linspace(0.4, 2, 7) + rng.normal(0, 0.01, (80, 1))
    m[rng.random(m.shape) < 0.1] = 0  # a missing return counts as zero
    df = frame(spark, {f"S{j}": m[:, j].tolist() for j in range(7)}, ("ret",)).withColumn("ret", F.expr("nullif(ret, 0)"))
    df = df.unionByName(df.where("symbol = 'S0'").select(F.lit("FLAT").alias("symbol"), *[(F.lit(0.0) if c == "ret" else F.col(c)).alias(c) for c in df.columns if c != "symbol"]), allowMissingColumns=True)
    search = optimizer.Search(df, points=6, rounds=32)
    found = search.solve()
    cov, mu = np.cov(m.T), m.mean(0)
    for r in found.itertuples():
        w = least(cov, mu, r.appetite)
        assert math.isclose(r.expected_return, mu @ w * 252, rel_tol=1e-4) and math.isclose(r.volatility, math.sqrt(w @ cov @ w * 252), rel_tol=1e-4) and 0 <= r.gap < 1e-3
        own = {x.symbol: x.weight for x in search.weights_of({int(r.point): 1.0}).collect()}
        assert math.isclose(sum(own.values()), 1) and min(own.values()) >= 0 and "FLAT" not in own
        assert np.allclose([own[f"S{j}"] for j in range(7)], w, atol=2e-3)
    assert math.isclose(found["expected_return"].iloc[-1], mu.max() * 252, rel_tol=1e-6)


def test_weight_search_objectives(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(0.0005, 0.02, (60, 5)) * np.linspace(0.5, 2, 5)
    df = frame(spark, {f"S{j}": m[:, j].tolist() for j in range(5)}, ("ret",))
    single = {"ret": m.mean(0) * 252, "vol": m.std(0, ddof=1) * math.sqrt(252)}
    middle = (single["ret"].max() + single["ret"].mean()) / 2
    best = {r.objective: r for r in optimizer.weight_search(df, target_return=middle, target_volatility=float(single["vol"].mean()), points=8, rounds=20).collect()}
    assert best["min_volatility"].volatility <= single["vol"].min() and best["max_return"].expected_return >= single["ret"].max() - 1e-9
    assert best["sharpe"].sharpe_ratio >= (single["ret"] / single["vol"]).max() - 1e-9
    assert math.isclose(best["target_return"].expected_return, middle, rel_tol=1e-6) and best["target_return"].volatility <= best["max_return"].volatility
    assert best["target_volatility"].volatility <= single["vol"].mean() * (1 + 1e-6)
    assert optimizer.weight_search(df.limit(0)).count() == optimizer.efficient_frontier(df.limit(0)).count() == 0


def test_steps_of_the_search_store_weights_alone(spark):
    """The series stay where they are: no step writes or shuffles them, with an asset that has no name as well."""
    rng = np.random.default_rng(11)
    df = frame(spark, {f"S{j}": rng.normal(0, 0.02, 30).tolist() for j in range(5)}, ("ret",)).withColumn("symbol", F.expr("nullif(symbol, 'S3')"))
    search = optimizer.Search(df, points=4, rounds=3)
    assert len(search.solve()) == 4 and not {"days", "rets"} & set(search.table.columns)
    plan = search.met(search.table)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    own = {x.symbol: x.weight for x in search.weights_of({0: 1.0}).collect()}
    assert set(own) == {"S0", "S1", "S2", None, "S4"} and math.isclose(sum(own.values()), 1)


def test_portfolio_risk_adds_up(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(0, 0.02, (60, 4))
    df = frame(spark, {f"S{j}": m[:, j].tolist() for j in range(4)}, ("ret",))
    w = spark.createDataFrame([(1, f"S{j}", float(j + 1)) for j in range(4)], "portfolio_id int, symbol string, weight double")
    rows = pf.portfolio_risk(df, w).collect()
    wv = np.arange(1, 5) / 10
    vol = math.sqrt(wv @ (np.cov(m.T) * 252) @ wv)
    assert math.isclose(rows[0]["volatility"], vol, rel_tol=1e-9) and math.isclose(sum(r["percent_contribution"] for r in rows), 100, rel_tol=1e-9)
    assert math.isclose(next(r["beta"] for r in rows if r["symbol"] == "S0"), 1.0, rel_tol=1e-9)


def test_backtest_follows_the_loop(spark):
    rng = np.random.default_rng(10)
    t, p = 100 + np.cumsum(rng.normal(0, 1, 40)), 100 + np.cumsum(rng.normal(0, 1, 40))
    df = frame(spark, {"A": list(zip(t.tolist(), p.tolist()))}, ("y_true", "y_pred")).withColumn("model", F.lit("m"))
    got = ordered(forecast.strategy_equity(df), "strategy_equity")["strategy_equity"]
    eq, pos, want = 10000.0, 0, [10000.0]
    for i in range(1, 40):
        eq *= 1 + (t[i] / t[i - 1] - 1) * pos
        s = np.sign(p[i] - p[i - 1])
        if (pos == 0 and s > 0) or (pos == 1 and s < 0):
            pos, eq = 1 - pos, eq * 0.999
        want.append(eq)
    assert np.allclose(got, want, rtol=1e-10)


def test_ensemble_weights():
    base = {"a": 0.5, "b": 0.5}
    assert forecast.ensemble_weights(base, add={"c": None}) == {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}
    assert forecast.ensemble_weights(base, add={"c": 1.0}) == {"a": 0.25, "b": 0.25, "c": 0.5}
    assert forecast.ensemble_weights(base, remove="a") == {"b": 1.0}
    with pytest.raises(ValueError):
        forecast.ensemble_weights(base, change={"z": 1.0})


def test_stacking_covers_every_row(spark):
    table = forecast.training_table(bars(spark, 200), min_rows=100)
    out, _ = forecast.stacking(table, folds=3)
    assert out.count() == table.count() and out.where("prediction IS NULL").count() == 0


def test_peers_rank_the_copy_first(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 0.02, 60)
    vals = {"T": base, "COPY": base * 1.5, "NOISE": rng.normal(0, 0.02, 60), "SHORT": base[:30]}
    df = frame(spark, {k: v.tolist() for k, v in vals.items()}, ("ret",))
    got = peers.peer_compare(df, "T").collect()
    assert got[0]["symbol"] == "COPY" and math.isclose(got[0]["beta"], 1.5) and {r["symbol"] for r in got} == {"COPY", "NOISE"}


def test_rolling_drawdown(spark):
    r = np.random.default_rng(12).normal(0, 0.02, 30)
    got = ordered(features.rolling_metrics(frame(spark, {"A": r.tolist()}, ("ret",)), 10), "max_drawdown")["max_drawdown"]
    for i in range(30):
        if i < 9:
            assert pd.isna(got[i])
        else:
            c = np.cumprod(1 + r[i - 9:i + 1])
            assert math.isclose(got[i], (c / np.maximum.accumulate(c) - 1).min(), abs_tol=1e-12)


@pytest.mark.parametrize("at", [[0], [0, 1], [5], [10, 11, 12], [29], [0, 7, 8, 29], list(range(30))])
def test_exponential_means_step_over_nulls(spark, at):
    import pandas as pd

    values = [None if i in at else 100 + (i * 7919 % 23) / 3 for i in range(30)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "symbol long, date int, close double")
    for span in (2, 3, 12):
        want = pd.Series(values, dtype=float).ewm(span=span, adjust=False, ignore_na=True).mean()
        adjusted = pd.Series(values, dtype=float).ewm(span=span, adjust=True, ignore_na=True).mean()
        got = indicators.ema_adjusted(indicators.ema(df, span, out="y"), span, out="z").orderBy("date").collect()
        for r, a, b in zip(got, want, adjusted):
            assert (r.y is None and pd.isna(a)) or r.y == pytest.approx(a, rel=1e-12)
            assert (r.z is None and pd.isna(b)) or r.z == pytest.approx(b, rel=1e-12)


def test_rolling_frames_need_all_values(spark):
    from barloom.functions.frames import roll

    df = spark.createDataFrame([(1, i, None if i == 4 else float(i)) for i in range(10)], "symbol long, date int, close double")
    got = {r.date: r.m for r in df.select("date", roll(F.avg, "close", 3).alias("m")).collect()}
    assert got == {0: None, 1: None, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None, 7: 6.0, 8: 7.0, 9: 8.0}


def test_ranges_split_a_hot_value(spark):
    """A third of the rows have one value among 2,500 others: no range holds much more than its share."""
    from barloom.sources import readers

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2500).alias("a"), F.col("id").alias("b"))
    sizes = []
    keep = readers.materialize

    def watched(df, name="stage"):
        stored = keep(df, name)
        sizes.extend(r["count"] for r in stored.groupBy("_r").count().collect())
        return stored

    readers.materialize = watched
    try:
        got = with_row_index(rows, "a", ["b"], size=3000)
        assert got.select("a", "b").orderBy("row_index").limit(30_000).collect() == rows.orderBy("a", "b").limit(30_000).collect()
    finally:
        readers.materialize = keep
    assert max(sizes) < 2 * 3000 and sum(sizes) == 60_000


def test_symbol_models_solve_the_normal_equations(spark):
    """Six features against least squares; a constant feature, a constant target, nulls, a symbol without a complete row."""
    from barloom.operators import forecast as fc

    rng = np.random.default_rng(9)
    frames = []
    for symbol, n in (("a", 300), ("b", 40), ("flat", 50), ("none", 3)):
        x = rng.normal(3, 2, (n, 6))
        x[:, 1] += 0.9 * x[:, 0]
        x[:, 5] = 7.0 if symbol == "b" else x[:, 5]
        y = np.full(n, 2.0) if symbol == "flat" else x @ rng.normal(0, 1, 6) + rng.normal(0, 0.1, n) + 5
        frames.append(pd.DataFrame(x, columns=fc.FEATURES).assign(target=y if symbol != "none" else np.nan, symbol=symbol))
    df = pd.concat(frames)
    table = spark.createDataFrame(df.astype(object).where(df.notna(), None), ", ".join(f"{f} double" for f in fc.FEATURES) + ", target double, symbol string").repartition(5)
    for ridge in (0.0, 0.01):
        got = {r["symbol"]: r for r in fc.symbol_models(table, ridge=ridge).collect()}
        assert set(got) == {"a", "b", "flat"}
        for symbol, r in got.items():
            part = df[df.symbol == symbol]
            x = (part[fc.FEATURES] - part[fc.FEATURES].mean()).to_numpy()
            y = part.target.to_numpy()
            left = x.T @ x / len(x)
            want = np.linalg.pinv(left + ridge * np.diag(np.diag(left))) @ (x.T @ (y - y.mean()) / len(x))
            assert np.allclose(r["coefficients"], want, atol=1e-8) and r["n"] == len(part)
            e = y - (r["intercept"] + part[fc.FEATURES].to_numpy() @ want)
            assert (r["r2"] is None) == (symbol == "flat") and (symbol == "flat" or math.isclose(r["r2"], 1 - e.var() / y.var(), abs_tol=1e-6))
            assert math.isclose(sum(r["importances"]), 0 if symbol == "flat" else 1, abs_tol=1e-9)
    models = fc.symbol_models(table)
    out = fc.symbol_forecasts(table, models).toPandas()
    assert out[out.symbol == "none"].prediction.isna().all() and out[out.symbol != "none"].prediction.notna().all() and len(out) == len(df)
