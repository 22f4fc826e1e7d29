"""Plans for training, ensembles, forecast metrics and the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import forecast as fc
from barloom.plans.oracle import W, roll
from barloom.registry import query
from barloom.sources.readers import materialize
from barloom.sources.tables import Tables

P = "predictions"
WM = "PARTITION BY model, symbol ORDER BY date"
WEIGHTS = {"naive": 0.5, "mean5": 0.3, "mean10": 0.2}
WC = "CASE model WHEN 'naive' THEN 0.5 WHEN 'mean5' THEN 0.3 ELSE 0.2 END::DOUBLE"
TT = f""", a AS (SELECT symbol, date, close, volume, close / lag(close) OVER ({W}) - 1 AS ret_1, close / lag(close, 5) OVER ({W}) - 1 AS ret_5, close / lag(close, 10) OVER ({W}) - 1 AS ret_10,
  volume / {roll('avg', 'volume', 20)} AS volume_rel, lead(close, 5) OVER ({W}) / close - 1 AS target, close / {roll('avg', 'close', 20)} - 1 AS to_mean FROM bars),
b AS (SELECT *, {roll('stddev_samp', 'ret_1', 10)} AS vol_10 FROM a), c AS (SELECT * FROM b WHERE target IS NOT NULL AND volume_rel IS NOT NULL AND vol_10 IS NOT NULL AND ret_10 IS NOT NULL),
tt AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY symbol) >= 100)"""
TTC = "ret_1 ret_5 ret_10 volume_rel target to_mean vol_10"


@query("training_table", f"{TT} SELECT * FROM tt", "bars", r6=TTC)
def _(t: Tables):
    return fc.training_table(t.bars)


@query("time_split", f"{TT} SELECT symbol, date, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS is_train FROM tt", "bars")
def _(t: Tables):
    return fc.time_split(fc.training_table(t.bars)).select("symbol", "date", "is_train")


@query("train_predict")
def _(t: Tables):
    return fc.train_predict(fc.training_table(t.bars))[0]


@query("batch_predict")
def _(t: Tables):
    table = materialize(fc.time_split(fc.training_table(t.bars)), "training")  # split before it is stored, so that no pass of the fit deals the rows again
    model = fc.model_chain("linear").fit(table.where("is_train"))
    return fc.batch_predict(table.drop("is_train"), model)


OWN = f"""{TT}, sp AS (SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS is_train FROM tt),
s AS (SELECT symbol, count(*) AS n, avg(ret_1) AS m1, avg(to_mean) AS m2, avg(target) AS m, var_pop(ret_1) * 1.01 AS v1, var_pop(to_mean) * 1.01 AS v2, covar_pop(ret_1, to_mean) AS v12,
  covar_pop(ret_1, target) AS c1, covar_pop(to_mean, target) AS c2 FROM sp WHERE is_train GROUP BY 1),
md AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2, abs(b1) * sqrt(v1 / 1.01) AS w1, abs(b2) * sqrt(v2 / 1.01) AS w2 FROM s)"""
TWO = ["ret_1", "to_mean"]


@query("symbol_models", f"{OWN} SELECT symbol, n, m - b1 * m1 - b2 * m2 AS intercept, b1 AS ret_1, b2 AS to_mean, w1 / (w1 + w2) AS importance FROM md", "bars", r6="intercept", r4="ret_1 to_mean importance")
def _(t: Tables):
    """Two features, so that SQL can solve the same equations."""
    models = fc.symbol_models(fc.time_split(fc.training_table(t.bars)).where("is_train"), TWO)
    at = lambda c, i: F.get(c, F.lit(i))
    return models.select("symbol", "n", "intercept", at("coefficients", 0).alias("ret_1"), at("coefficients", 1).alias("to_mean"), at("importances", 0).alias("importance"))


@query("symbol_forecasts", f"{OWN} SELECT symbol, date, target, m + b1 * (ret_1 - m1) + b2 * (to_mean - m2) AS prediction FROM sp JOIN md USING (symbol) WHERE NOT is_train", "bars", r6="target prediction")
def _(t: Tables):
    parts = materialize(fc.time_split(fc.training_table(t.bars)), "training")
    models = fc.symbol_models(parts.where("is_train"), TWO)
    return fc.symbol_forecasts(parts.where("NOT is_train"), models, TWO).select("symbol", "date", "target", "prediction")


@query("stacking")
def _(t: Tables):
    return fc.stacking(fc.training_table(t.bars), folds=5)[0]


@query("ensemble_weighted", f"SELECT symbol, date, max(y_true) AS y_true, sum({WC} * y_pred) AS y_pred FROM predictions GROUP BY 1, 2", P, r4="y_pred")
def _(t: Tables):
    return fc.ensemble(t.predictions, WEIGHTS)


@query("ensemble_vote", f"""SELECT symbol, date, max(CASE WHEN y_true > 100 THEN 1 ELSE 0 END)::DOUBLE AS y_true, CAST(sum({WC} * (y_pred / 200 >= 0.5)::INT) > 0.5 AS INTEGER) AS y_pred FROM predictions GROUP BY 1, 2""", P)
def _(t: Tables):
    share = t.predictions.withColumns({"y_pred": F.col("y_pred") / 200, "y_true": (F.col("y_true") > 100).cast("double")})
    return fc.ensemble(share, {"naive": 0.5, "mean5": 0.3, "mean10": 0.2}, "vote")


@query("ensemble_direction", f""", d AS (SELECT *, coalesce(sign(y_pred - lag(y_pred) OVER ({WM})), 0) AS d FROM predictions)
SELECT symbol, date, max(y_true) AS y_true, sign(round(sum({WC} * d), 12))::DOUBLE AS y_pred FROM d GROUP BY 1, 2""", P)
def _(t: Tables):
    return fc.ensemble(t.predictions, WEIGHTS, "direction")


@query("ensemble_weights", """, r AS (SELECT model, 1 / sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS s FROM predictions GROUP BY 1) SELECT model, s / sum(s) OVER () AS weight FROM r""", P, r6="weight")
def _(t: Tables):
    # one row per model: weights by inverse error, scaled to sum one
    e = fc.regression_metrics(t.predictions, ["model"]).select("model", (1 / F.col("rmse")).alias("s"))
    return e.select("model", (F.col("s") / e.agg(F.sum("s")).scalar()).alias("weight"))


@query("ensemble_uncertainty", "SELECT symbol, date, avg(y_pred) AS mean_prediction, stddev_pop(y_pred) AS std_deviation, min(y_pred) AS min_prediction, max(y_pred) AS max_prediction FROM predictions GROUP BY 1, 2", P,
       r4="mean_prediction std_deviation min_prediction max_prediction")
def _(t: Tables):
    return fc.ensemble_uncertainty(t.predictions)


@query("prediction_interval", f"SELECT symbol, date, sum({WC} * y_pred) AS prediction, sum({WC} * y_pred * 0.95) AS lower, sum({WC} * y_pred * 1.05) AS upper FROM predictions GROUP BY 1, 2", P, r4="prediction lower upper")
def _(t: Tables):
    return fc.prediction_interval(t.predictions, WEIGHTS)


@query("ensemble_importance", f""", e AS (SELECT model, CAST(dayofweek(date) AS VARCHAR) AS feature, avg(abs(y_true - y_pred)) AS importance FROM predictions GROUP BY 1, 2),
f AS (SELECT feature, sum({WC} * importance) AS v FROM e GROUP BY 1) SELECT feature, v / sum(v) OVER () AS importance FROM f""", P, r6="importance")
def _(t: Tables):
    rows = t.predictions.groupBy("model", (F.dayofweek("date") - 1).cast("string").alias("feature")).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("importance"))
    return fc.ensemble_importance(rows, WEIGHTS)


BASIC = """avg((y_true - y_pred) * (y_true - y_pred)) AS mse, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
  1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true) AS r2, avg(abs((y_true - y_pred) / y_true)) * 100 AS mape"""
BC = "mse rmse mae r2 mape"
STEPS = f", st AS (SELECT *, y_true - lag(y_true) OVER ({WM}) AS dt, y_pred - lag(y_pred) OVER ({WM}) AS dp FROM predictions)"
DIR = "avg(CASE WHEN dt IS NOT NULL THEN (sign(dt) = sign(dp))::INT END) AS directional_accuracy, sum(CASE WHEN sign(dt) = sign(dp) THEN abs(dt) ELSE 0 END) / sum(abs(dt)) AS weighted_directional_accuracy"


@query("regression_metrics", f"SELECT model, symbol, {BASIC} FROM predictions GROUP BY 1, 2", P, r6=BC)
def _(t: Tables):
    return fc.regression_metrics(t.predictions)


@query("directional_accuracy", f"{STEPS}, m AS (SELECT model, symbol, {DIR} FROM st GROUP BY 1, 2) SELECT model, symbol, directional_accuracy FROM m", P, r6="directional_accuracy")
def _(t: Tables):
    return fc.directional(t.predictions).select("model", "symbol", "directional_accuracy")


@query("weighted_directional_accuracy", f"{STEPS}, m AS (SELECT model, symbol, {DIR} FROM st GROUP BY 1, 2) SELECT model, symbol, weighted_directional_accuracy FROM m", P, r6="weighted_directional_accuracy")
def _(t: Tables):
    return fc.directional(t.predictions).select("model", "symbol", "weighted_directional_accuracy")


PRC = f""", pr AS (SELECT symbol, date, close / lag(close) OVER ({W}) - 1 AS ret, 1 - close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS fall FROM bars),
pm AS (SELECT symbol, avg(ret - (pow(1.02, 1 / 252.0) - 1)) / stddev_pop(ret) * sqrt(252) AS sharpe, avg(ret - (pow(1.02, 1 / 252.0) - 1)) / stddev_pop(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino,
  max(fall) AS max_drawdown, avg(ret) * 252 / max(fall) AS calmar FROM pr GROUP BY 1)"""

for key, column in (("eval_sharpe", "sharpe"), ("eval_sortino", "sortino"), ("calmar", "calmar"), ("eval_max_drawdown", "max_drawdown")):
    @query(key, f"{PRC} SELECT symbol, {column} FROM pm", "bars", r6=column)
    def _(t: Tables, column=column):
        return fc.price_metrics(t.bars, rf=0.02).select("symbol", column)


STRAT = f"""{STEPS}, s1 AS (SELECT *, coalesce(y_true / lag(y_true) OVER ({WM}) - 1, 0) AS r, first(y_true) OVER ({WM} ROWS UNBOUNDED PRECEDING) AS f,
  coalesce(last_value(CASE WHEN sign(dp) <> 0 THEN (dp > 0)::INT END IGNORE NULLS) OVER ({WM} ROWS UNBOUNDED PRECEDING), 0) AS pos FROM st),
s2 AS (SELECT *, (1 + coalesce(lag(pos) OVER ({WM}), 0) * r) * CASE WHEN pos <> coalesce(lag(pos) OVER ({WM}), 0) THEN 0.999 ELSE 1 END AS step FROM s1),
s3 AS (SELECT model, symbol, date, r, step - 1 AS sr, exp(sum(ln(step)) OVER ({WM} ROWS UNBOUNDED PRECEDING)) AS se, y_true / f AS be FROM s2),
s4 AS (SELECT *, 1 - se / max(se) OVER ({WM} ROWS UNBOUNDED PRECEDING) AS fs, 1 - be / max(be) OVER ({WM} ROWS UNBOUNDED PRECEDING) AS fb FROM s3),
bt AS (SELECT model, symbol, arg_max(se, date) - 1 AS strategy_total_return, coalesce(avg(sr) / nullif(stddev_pop(sr), 0), 0) * sqrt(252) AS strategy_sharpe, max(fs) AS strategy_max_drawdown,
  arg_max(be, date) - 1 AS buy_and_hold_total_return, avg(r) / stddev_pop(r) * sqrt(252) AS buy_and_hold_sharpe, max(fb) AS buy_and_hold_max_drawdown FROM s4 GROUP BY 1, 2)"""
SC = "strategy_total_return strategy_sharpe strategy_max_drawdown buy_and_hold_total_return buy_and_hold_sharpe buy_and_hold_max_drawdown"


@query("strategy_backtest", f"{STRAT} SELECT * FROM bt", P, r6=SC)
def _(t: Tables):
    return fc.strategy_backtest(t.predictions)


@query("evaluate_model", f"{STRAT}, m AS (SELECT model, symbol, {BASIC}, {DIR} FROM st GROUP BY 1, 2) SELECT * FROM m JOIN bt USING (model, symbol)", P, r6=f"{BC} directional_accuracy weighted_directional_accuracy {SC}")
def _(t: Tables):
    return fc.evaluate_model(t.predictions)


@query("compare_models", f"{STEPS}, m AS (SELECT model, {BASIC}, {DIR} FROM st GROUP BY 1) SELECT model, rmse, mae, directional_accuracy FROM m", P, r6="rmse mae directional_accuracy")
def _(t: Tables):
    return fc.compare_models(t.predictions)


@query("feature_health", f"""{TT}, x AS (SELECT CASE WHEN ret_1 > 0.1 THEN 'inf'::DOUBLE ELSE ret_1 END AS ret_1, CASE WHEN vol_10 > 0.04 THEN NULL ELSE vol_10 END AS vol_10 FROM tt)
SELECT 'ret_1' AS feature, CAST(count_if(ret_1 IS NULL) AS BIGINT) AS nulls, CAST(count_if(isinf(ret_1)) AS BIGINT) AS infinities FROM x UNION ALL SELECT 'vol_10', CAST(count_if(vol_10 IS NULL) AS BIGINT), CAST(count_if(isinf(vol_10)) AS BIGINT) FROM x""", "bars")
def _(t: Tables):
    df = fc.training_table(t.bars).select(F.when(F.col("ret_1") > 0.1, float("inf")).otherwise(F.col("ret_1")).alias("ret_1"), F.when(~(F.col("vol_10") > 0.04), F.col("vol_10")).alias("vol_10"))
    return fc.feature_health(df, ["ret_1", "vol_10"])
