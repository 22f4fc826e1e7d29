"""Training tables, Spark ML jobs, ensembles, forecast metrics and the long/flat backtest.

Forecasts are rows (model, symbol, date, y_true, y_pred).  A (model, symbol) series is calendar-bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import prev, rate, roll, series
from barloom.sources.readers import materialize

MS = ["model", "symbol"]


def training_table(bars: DataFrame, horizon: int = 5, min_rows: int = 100) -> DataFrame:
    """Features and the forward return, complete rows only, symbols with fewer rows left out."""
    df = bars.select("symbol", "date", "close", "volume")
    df = df.withColumns({
        "ret_1": rate("close"), "ret_5": rate("close", 5), "ret_10": rate("close", 10), "_m": roll(F.avg, "close", 20),
        "volume_rel": F.try_divide(F.col("volume"), roll(F.avg, "volume", 20)), "target": F.try_divide(F.lead("close", horizon).over(series()), F.col("close")) - 1})
    df = df.withColumns({"to_mean": F.try_divide(F.col("close"), F.col("_m")) - 1, "vol_10": roll(F.stddev_samp, "ret_1", 10)})
    df = df.drop("_m").where("target IS NOT NULL").na.drop("any")
    n = F.count("*").over(W.partitionBy("symbol"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


FEATURES = ["ret_1", "ret_5", "ret_10", "volume_rel", "to_mean", "vol_10"]


def time_split(df: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Marks the first share of each symbol's rows as training rows, in date order."""
    w = W.partitionBy("symbol")
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("date"))
    return df.withColumn("is_train", i <= F.floor(n * train_share))


def model_chain(kind: str, features=None, label: str = "target", seed: int = 42) -> Pipeline:
    features = features or FEATURES
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    makers = {
        "linear": lambda: LinearRegression(regParam=0.01), "tree": lambda: DecisionTreeRegressor(maxDepth=4, seed=seed),
        "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed), "boosted": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=seed)}
    if kind not in makers:
        raise ValueError(f"unknown model: {kind}")
    model = makers[kind]().setFeaturesCol("_x").setLabelCol(label).setPredictionCol("prediction")
    return Pipeline(stages=[*stages, model])


def train_predict(table: DataFrame, kinds=("linear", "tree"), train_share: float = 0.8) -> tuple[DataFrame, dict]:
    """One model per kind over all symbols, predictions for the later rows, and the fitted models."""
    parts = materialize(time_split(table, train_share), "training")  # fitting passes over it many times
    train, test = parts.where("is_train"), parts.where("NOT is_train")
    out, fitted = None, {}
    for kind in kinds:
        fitted[kind] = model_chain(kind).fit(train)
        p = fitted[kind].transform(test).select(F.lit(kind).alias("model"), "symbol", "date", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred"))
        out = p if out is None else out.unionByName(p)
    return out, fitted


def importances(fitted: dict, features=None) -> list[tuple[str, str, float]]:
    """(model, feature, importance) of fitted models: tree importances or absolute coefficients."""
    rows = []
    for kind, model in fitted.items():
        last = model.stages[-1]
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
        rows += [(kind, f, float(v)) for f, v in zip(features or FEATURES, values)]
    return rows


def batch_predict(table: DataFrame, model) -> DataFrame:
    """Prediction from the newest feature row of every symbol."""
    rest = [c for c in table.columns if c != "symbol"]
    newest = table.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("r")).select("symbol", *[F.col(f"r.{c}").alias(c) for c in rest])
    return model.transform(newest).select("symbol", "date", F.col("close").alias("current_price"), "prediction",
                                          (F.col("close") * (1 + F.col("prediction"))).alias("predicted_price"))


def symbol_models(table: DataFrame, features=None, target: str = "target", ridge: float = 0.01) -> DataFrame:
    """A linear model per symbol: symbol, n, intercept, coefficients, importances, r2.

    The covariances of the features and the target are mergeable sums, so a symbol of any length is one small row behind the
    shuffle; the systems of a batch of symbols are solved together.  ``ridge`` is a share of each feature's variance that
    is added to it.  Importances are |coefficient| x deviation, scaled to sum one.  A feature that never changes has the
    coefficient zero; rows with a null feature or target are left out, and a symbol without any other has no model.
    """
    features = list(features or FEATURES)
    k = len(features)
    known = table.select("symbol", *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate([*features, target])]).na.drop(subset=[f"x{i}" for i in range(k + 1)])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = known.groupBy("symbol").agg(F.count("*").alias("n"), F.array(*[F.avg(f"x{i}") for i in range(k + 1)]).alias("m"),
                                       F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs]).alias("c"))

    @F.pandas_udf("intercept double, coefficients array<double>, importances array<double>, r2 double")
    def solve(means: pd.Series, covariances: pd.Series) -> pd.DataFrame:
        m, c = np.stack(means.to_list()), np.stack(covariances.to_list())
        full = np.zeros((len(m), k + 1, k + 1))
        for place, (i, j) in enumerate(pairs):
            full[:, i, j] = full[:, j, i] = c[:, place]
        spread = np.diagonal(full, axis1=1, axis2=2)
        still = spread[:, :k] <= 1e-24 * (1 + m[:, :k] ** 2)
        left = full[:, :k, :k].copy()
        left[:, range(k), range(k)] = np.where(still, 1.0, spread[:, :k] * (1 + ridge))
        right = np.where(still, 0.0, full[:, :k, k])
        left = np.where(still[:, :, None] | still[:, None, :], np.eye(k) , left)
        beta = (np.linalg.pinv(left) @ right[:, :, None])[:, :, 0] if not ridge else np.linalg.solve(left, right[:, :, None])[:, :, 0]
        weight = np.abs(beta) * np.sqrt(np.maximum(spread[:, :k], 0))
        total = weight.sum(1, keepdims=True)
        residual = spread[:, k] - 2 * (beta * right).sum(1) + (beta[:, None, :] @ full[:, :k, :k] @ beta[:, :, None])[:, 0, 0]
        r2 = [1 - e / v if v > 0 else None for e, v in zip(residual, spread[:, k])]
        return pd.DataFrame({"intercept": m[:, k] - (beta * m[:, :k]).sum(1), "coefficients": list(beta),
                             "importances": list(np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)), "r2": r2})

    return sums.withColumn("s", solve("m", "c")).select("symbol", "n", "s.*")


def symbol_forecasts(table: DataFrame, models: DataFrame, features=None) -> DataFrame:
    """Every row with the ``prediction`` of its symbol's model; null where the model or a feature is missing."""
    x = F.array(*[F.col(f).cast("double") for f in (features or FEATURES)])
    value = F.aggregate(F.zip_with("coefficients", x, lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b)
    return table.join(models.select("symbol", "intercept", "coefficients"), "symbol", "left").withColumn("prediction", value).drop("intercept", "coefficients")


def stacking(table: DataFrame, kinds=("linear", "tree"), folds: int = 5) -> tuple[DataFrame, object]:
    """Out-of-fold base predictions (folds by row hash) and a linear model over them."""
    df = materialize(table.withColumn("_fold", F.pmod(F.xxhash64("symbol", "date"), F.lit(folds))), "folds")
    parts = None
    for k in range(folds):
        train, held = df.where(F.col("_fold") != k), df.where(F.col("_fold") == k)
        for kind in kinds:
            held = model_chain(kind).fit(train).transform(held).withColumnRenamed("prediction", f"p_{kind}").drop("_raw", "_x")
        parts = held if parts is None else parts.unionByName(held)
    meta_features = [f"p_{k}" for k in kinds]
    parts = materialize(parts, "stacked")
    meta = model_chain("linear", meta_features).fit(parts)
    return meta.transform(parts).select("symbol", "date", "target", *meta_features, "prediction"), meta


# ---- ensembles over forecast rows ----

def ensemble_weights(base: dict[str, float], change: dict[str, float] | None = None, add: dict[str, float | None] | None = None, remove: str | None = None) -> dict[str, float]:
    """Model weights after setting, adding or removing, scaled to sum one; adding without a weight makes all equal."""
    w = dict(base)
    for name, value in (change or {}).items():
        if name not in w:
            raise ValueError(f"model {name} is not in the ensemble")
        w[name] = value
    for name, value in (add or {}).items():
        if name in w:
            raise ValueError(f"model {name} is already in the ensemble")
        w[name] = value if value is not None else 0.0
        if value is None:
            w = {k: 1.0 for k in w}
    if remove is not None:
        if remove not in w:
            raise ValueError(f"model {remove} is not in the ensemble")
        del w[remove]
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def weight_of(weights: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("model")]


def ensemble(preds: DataFrame, weights: dict[str, float], method: str = "weighted") -> DataFrame:
    """One prediction per (symbol, date): weighted mean, weighted vote at 0.5, or sign of the weighted directions."""
    df = preds.withColumn("_w", weight_of(weights))
    p, w = F.col("y_pred"), F.col("_w")
    if method == "weighted":
        value = F.sum(w * p)
    elif method == "vote":
        value = (F.sum(w * (p >= 0.5).cast("int")) > 0.5).cast("int")
    elif method == "direction":
        df = df.withColumn("_d", F.coalesce(F.signum(p - prev(p, 1, series(MS))), F.lit(0.0)))
        value = F.signum(F.round(F.sum(w * F.col("_d")), 12))
    else:
        raise ValueError(f"unknown ensemble method: {method}")
    return df.groupBy("symbol", "date").agg(F.max("y_true").alias("y_true"), value.alias("y_pred"))


def ensemble_uncertainty(preds: DataFrame) -> DataFrame:
    return preds.groupBy("symbol", "date").agg(F.avg("y_pred").alias("mean_prediction"), F.stddev_pop("y_pred").alias("std_deviation"),
                                               F.min("y_pred").alias("min_prediction"), F.max("y_pred").alias("max_prediction"))


def prediction_interval(preds: DataFrame, weights: dict[str, float], lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Weighted point and bounds; five percent around the prediction for rows without bounds."""
    p = F.col("y_pred")
    lo = F.coalesce(F.col(lower), p * 0.95) if lower else p * 0.95
    hi = F.coalesce(F.col(upper), p * 1.05) if upper else p * 1.05
    df = preds.withColumns({"_w": weight_of(weights), "_lo": lo, "_hi": hi})
    return df.groupBy("symbol", "date").agg(F.sum(F.col("_w") * p).alias("prediction"), F.sum(F.col("_w") * F.col("_lo")).alias("lower"),
                                            F.sum(F.col("_w") * F.col("_hi")).alias("upper"))


def ensemble_importance(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weight-averaged importances scaled to sum one; rows are (model, feature, importance)."""
    df = rows.groupBy("feature").agg(F.sum(weight_of(weights) * F.col("importance")).alias("v"))
    return df.select("feature", st.ratio(F.col("v"), df.agg(F.sum("v")).scalar()).alias("importance"))


# ---- metrics ----

def with_steps(preds: DataFrame) -> DataFrame:
    """Adds the change of truth and forecast since the previous row of the series."""
    w = series(MS)
    return preds.withColumns({"dt": F.col("y_true") - prev("y_true", 1, w), "dp": F.col("y_pred") - prev("y_pred", 1, w)})


def _basic() -> dict[str, Column]:
    t, p = F.col("y_true"), F.col("y_pred")
    mse = F.avg((t - p) * (t - p))
    mape = F.when(F.count_if(t == 0) == 0, F.avg(F.abs(F.try_divide(t - p, t))) * 100)
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(t - p)), "r2": 1 - F.try_divide(mse, F.var_pop(t)), "mape": mape}


def _directional() -> dict[str, Column]:
    same = F.signum("dt") == F.signum("dp")
    move = F.abs("dt")
    return {"directional_accuracy": F.avg(F.when(F.col("dt").isNotNull(), same.cast("double"))),
            "weighted_directional_accuracy": F.try_divide(F.sum(F.when(same, move).otherwise(F.when(move.isNotNull(), 0.0))), F.sum(move))}


def regression_metrics(preds: DataFrame, keys=MS) -> DataFrame:
    return preds.groupBy(*keys).agg(*[c.alias(n) for n, c in _basic().items()])


def directional(preds: DataFrame, keys=MS) -> DataFrame:
    return with_steps(preds).groupBy(*keys).agg(*[c.alias(n) for n, c in _directional().items()])


def eval_sharpe(x: str = "ret", rf: float = 0.0, factor: int = 252) -> Column:
    """Population-std Sharpe with a compounded risk-free rate per period."""
    step = (1 + rf) ** (1 / factor) - 1
    return st.ratio(F.avg(F.col(x) - step), F.stddev_pop(x)) * math.sqrt(factor)


def eval_sortino(x: str = "ret", rf: float = 0.0, factor: int = 252) -> Column:
    """Null instead of infinity when no loss or no spread of losses exists."""
    step = (1 + rf) ** (1 / factor) - 1
    return F.try_divide(F.avg(F.col(x) - step), F.stddev_pop(F.when(F.col(x) < 0, F.col(x)))) * math.sqrt(factor)


def fall_from_peak(price: str, w) -> Column:
    top = F.max(price).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.try_divide(top - F.col(price), top)


def price_metrics(bars: DataFrame, factor: int = 252, rf: float = 0.0) -> DataFrame:
    """Sharpe, Sortino, Calmar and drawdown of a price series, a fall on the first day counted."""
    df = bars.select("symbol", "date", "close", rate("close").alias("ret"), fall_from_peak("close", series()).alias("fall"))
    return df.groupBy("symbol").agg(eval_sharpe("ret", rf, factor).alias("sharpe"), eval_sortino("ret", rf, factor).alias("sortino"),
                                    F.max("fall").alias("max_drawdown"), F.try_divide(F.avg("ret") * factor, F.max("fall")).alias("calmar"))


def strategy_equity(preds: DataFrame, capital: float = 10000.0, cost: float = 0.001) -> DataFrame:
    """Equity of going long on a rising forecast and flat on a falling one, next to buy-and-hold.

    The position is the last non-zero sign of the forecast change; each row earns with the position of the row
    before it and pays the cost when its own position differs.
    """
    w = series(MS)
    all_before = w.rowsBetween(W.unboundedPreceding, 0)
    df = with_steps(preds)
    df = df.withColumns({"r": F.coalesce(F.try_divide(F.col("y_true"), prev("y_true", 1, w)) - 1, F.lit(0.0)),
                         "pos": F.coalesce(F.last(F.when(F.signum("dp") != 0, (F.signum("dp") > 0).cast("int")), ignorenulls=True).over(all_before), F.lit(0)),
                         "first": F.first("y_true").over(all_before)})
    was = F.coalesce(prev("pos", 1, w), F.lit(0))
    df = df.withColumn("step", (1 + was * F.col("r")) * F.when(F.col("pos") != was, 1 - cost).otherwise(1.0))
    df = df.withColumns({"strategy_equity": capital * F.exp(F.sum(F.ln("step")).over(all_before)),
                         "buy_and_hold_equity": capital * F.try_divide(F.col("y_true"), F.col("first")), "strategy_return": F.col("step") - 1})
    return df.select(*MS, "date", "pos", F.col("r").alias("buy_and_hold_return"), "strategy_return", "strategy_equity", "buy_and_hold_equity")


def strategy_backtest(preds: DataFrame, capital: float = 10000.0, cost: float = 0.001) -> DataFrame:
    w = series(MS)
    df = strategy_equity(preds, capital, cost)
    df = df.withColumns({"_fs": fall_from_peak("strategy_equity", w), "_fb": fall_from_peak("buy_and_hold_equity", w)})
    out = {}
    for name, fall in (("strategy", "_fs"), ("buy_and_hold", "_fb")):
        out |= {f"{name}_total_return": F.max_by(f"{name}_equity", "date") / capital - 1, f"{name}_sharpe": eval_sharpe(f"{name}_return"),
                f"{name}_max_drawdown": F.max(fall)}
    return df.groupBy(*MS).agg(*[c.alias(n) for n, c in out.items()])


def evaluate_model(preds: DataFrame) -> DataFrame:
    """Error, direction and strategy metrics per (model, symbol)."""
    base = with_steps(preds).groupBy(*MS).agg(*[c.alias(n) for n, c in (_basic() | _directional()).items()])
    return base.join(strategy_backtest(preds), MS)


def compare_models(preds: DataFrame, metrics=("rmse", "mae", "directional_accuracy")) -> DataFrame:
    """Model x metric table over all rows."""
    return with_steps(preds).groupBy("model").agg(*[c.alias(n) for n, c in (_basic() | _directional()).items() if n in metrics])


def feature_health(df: DataFrame, cols) -> DataFrame:
    """Null and infinity counts per feature in one pass."""
    inf = lambda c: F.count_if(F.abs(F.col(c).cast("double")) == float("inf"))
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("null", bad), ("inf", inf))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"null_{c}").alias("nulls"), F.col(f"inf_{c}").alias("infinities")) for c in cols]))
    return one.select(rows.alias("x")).select("x.*")
