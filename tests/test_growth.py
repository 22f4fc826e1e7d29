"""What a query sorts, deals and stores, where that decides how it grows."""

import contextlib
import datetime
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import decayed_sums, ewm_many
from barloom.functions.rolling import rolling_batches
from barloom.functions.scalars import rounded
from barloom.operators import cleaning, features, forecast, indicators, signals
from barloom.plans import load_all
from barloom.plans import sources as source_plans
from barloom.registry import REGISTRY
from barloom.sources import readers

BARS = "symbol long, date long, open double, high double, low double, close double, volume long"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def bars(spark, n=90, symbols=(1, 2)):
    rows = [(s, i, 100.0, 103.0 + i % 5, 98.0 - i % 3, 100.0 + (i * 7 * s) % 11, 10 + i % 4) for s in symbols for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def days(spark):
    return bars(spark).withColumn("date", F.date_add(F.lit("1998-01-01").cast("date"), F.col("date").cast("int")))


def tables(spark, folder) -> str:
    """Two symbols with a line item on each of 160 days."""
    orders = [(i, datetime.datetime(1998, 1, 1) + datetime.timedelta(days=i)) for i in range(160)]
    items = [(i, s, s, float(5 + i % 9), 1000.0 + (i * 37 * s) % 4000, 0.01 * (i % 7), 0.01 * (i % 5)) for i in range(160) for s in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def sorts(df) -> int:
    return plan(df).count(" Sort [")


def test_exponential_means_sort_once(spark):
    """F11 F13 F14 F23: every sort of a stage holds all rows of a task at the same time."""
    for df in (indicators.all_indicators(bars(spark)), signals.trading_signals(bars(spark)), indicators.keltner(bars(spark)),
               indicators.macd(bars(spark)), indicators.ema_adjusted(bars(spark), 10)):
        assert sorts(df) == 1


def test_exponential_means_skip_nulls_of_any_length(spark):
    values = [None, 5.0, *[None] * 900, 7.0, None, 9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "symbol long, date long, x double")
    got = [r.e for r in ewm_many(df, [("x", 9, "e")]).orderBy("date").collect()]
    want, y = [], None
    for v in values:
        y = y if v is None else v if y is None else 0.8 * y + 0.2 * v
        want.append(y)
    assert got[0] is None and max(abs(a - b) for a, b in zip(got[1:], want[1:])) < 1e-12
    got = [r.s for r in decayed_sums(df, [(F.col("x"), "s")], 0.9).orderBy("date").collect()]
    s, want = 0.0, []
    for i, v in enumerate(values):
        s = 0.9 * s + (v or 0.0)
        want.append(s if i else None)
    assert got[0] is None and max(abs(a - b) for a, b in zip(got[1:], want[1:])) < 1e-12


def test_trend_strength_fits_last_rows_only(spark):
    """the line is fitted once per symbol, not once per row."""
    df = bars(spark).unionByName(bars(spark, 62, (3,)))
    out = signals.trend_strength(df)
    assert not any("Window [" in line and "regr_" in line for line in plan(out).splitlines())
    got = {r.symbol: r for r in out.collect()}
    assert sorted(got) == [1, 2]  # 62 rows are too few
    for s, r in got.items():
        y = [100.0 + (i * 7 * s) % 11 for i in range(27, 90)]
        x = range(28, 91)
        mx, my = sum(x) / 63, sum(y) / 63
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        ups = sum(b > a for a, b in zip([100.0 + (26 * 7 * s) % 11, *y], y)) / 63
        assert abs(r.slope - slope / y[0] * 100) < 1e-9 and abs(r.directional_consistency - max(ups, 1 - ups)) < 1e-12


def test_fill_from_behind_is_one_value_per_series(spark):
    """F16: no frame from each row to the end of its series."""
    rows = [(1, 1, None, None), (1, 2, 4.0, None), (1, 3, 6.0, "a"), (1, 4, 8.0, None), (1, 5, 9.0, "b"), (2, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "symbol long, date long, x double, g string")
    out = cleaning.fill_median_ffill(df, ["x"], ["g"])
    assert "currentrow$(), unboundedfollowing$()" not in plan(out)
    assert [(r.x, r.g) for r in out.orderBy("symbol", "date").collect()] == [(6.0, "a"), (4.0, "a"), (6.0, "a"), (8.0, "a"), (9.0, "b"), (1.0, None)]


def test_text_files_are_packed(spark, tmp_path):
    """F17 F26: CSV and JSON are written compressed, and read back as they were."""
    for kind in ("csv", "json", "parquet"):
        path = readers.write_files(bars(spark, 40), str(tmp_path / f"x.{kind}"))
        assert kind == "parquet" or all(p.name.endswith(".gz") for p in (tmp_path / f"x.{kind}").glob("part-*"))
        assert sorted(readers.scan_files(spark, path, BARS).collect()) == sorted(bars(spark, 40).collect())


def test_upsert_indicators_computes_means_once(spark, monkeypatch, tmp_path):
    """the table and the batch start from stored means."""
    seen = []
    real = source_plans.stored_upsert
    monkeypatch.setattr(source_plans, "stored_upsert", lambda t, base, incoming, *a: seen.append(plan(base) + plan(incoming)) or real(t, base, incoming, *a))
    load_all()
    assert REGISTRY["upsert_indicators"].run(spark, tables(spark, tmp_path)).count() == 2 * (141 + 111)
    assert len(seen) == 1 and "Window" not in seen[0]


def test_batch_predict_deals_training_rows_once(spark, monkeypatch, tmp_path):
    """passes of the fit read stored rows and shuffle nothing."""
    seen = []
    real = forecast.model_chain

    class Chain:
        def __init__(self, chain):
            self.chain = chain

        def fit(self, df):
            seen.append(plan(df))
            return self.chain.fit(df)

    monkeypatch.setattr(forecast, "model_chain", lambda kind: Chain(real(kind)))
    load_all()
    assert REGISTRY["batch_predict"].run(spark, tables(spark, tmp_path)).count() == 2
    assert seen and "Exchange" not in seen[0] and "Window" not in seen[0]


def test_features_keep_no_frame_per_row(spark):
    df = features.all_features(days(spark).drop("open", "high", "low"))
    text = plan(df)
    assert "MapInArrow" in text and "RowFrame, -62" not in text and sorts(df) == 1
    # other functions still take any aggregate
    assert "RowFrame, -62" in plan(features.rolling_features(bars(spark), ["close"], [63], {"mean": F.avg}))


def test_rolling_batches_are_the_frames_bit_by_bit(spark):
    """Series over many batches, nulls in a value and in the key, NaN, an integer column; a column of the same name is replaced."""
    from barloom.functions.frames import roll

    rng = np.random.default_rng(4)
    rows = [(s, i, None if rng.random() < 0.05 else float(rng.normal(100, 9)) if i != 30 else math.nan,
             None if rng.random() < 0.03 else int(rng.integers(0, 2**40)), "t") for s in (None, 1, 2, 3) for i in range((s or 4) * 23)]
    df = spark.createDataFrame(rows, "symbol int, date int, x double, v long, x_mean_3 string").repartition(5)
    fns = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    want = df.withColumns({f"{c}_{k}_{n}": roll(f, c, n) for c in ("x", "v") for n in (1, 3, 20) for k, f in fns.items()})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rolling_batches(df, ["x", "v"], [1, 3, 20])
        a, b = (sorted(map(repr, t.collect())) for t in (got, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.dtypes == want.dtypes and a == b
    with pytest.raises(ValueError):
        rolling_batches(df, ["x"], [0])


def test_feature_columns_keep_their_order(spark):
    names = features.all_features(days(spark), lags=(1,), windows=(5,), return_periods=(1,)).columns
    assert names[7:9] == ["day_of_week", "day_of_month"] and names[17:19] == ["close_lag_1", "volume_lag_1"]
    assert names[19:] == [f"{c}_{k}_5" for c in ("close", "volume") for k in ("mean", "std", "min", "max")] + ["return_1d", "log_return_1d"]


def test_rounded_gives_the_bits_of_round(spark):
    """Ties, values beside them, signs, zeros, huge, infinite and missing ones, one and two columns."""
    rng = np.random.default_rng(6)
    xs = [0.00005, 1.00005, -1.00005, 2.5, -0.00001, -0.0, 0.0, 1e15 + 0.3, 123456789.00005, 1e300, math.inf, -math.inf, math.nan, None]
    xs += [float(x) for k in (1e-3, 1, 1e4, 1e8) for x in rng.normal(0, k, 300)] + [k / 100000 for k in range(-300, 300)]
    df = spark.createDataFrame([(x, xs[-1 - i] if i % 3 else None) for i, x in enumerate(xs)], "a double, b double")
    for d in (4, 6, 9):
        for cols in (["a"], ["a", "b"]):
            for r in df.select(rounded(cols, d).alias("got"), F.array(*[F.round(c, d) for c in cols]).alias("want")).collect():
                assert [repr(x) for x in r.got] == [repr(x) for x in r.want]


def test_queries_round_without_a_call_per_value(spark, tmp_path):
    load_all()
    df = REGISTRY["rolling_features"].run(spark, tables(spark, tmp_path))
    assert "THEN round(" not in plan(df) and "round(close_mean_5" not in plan(df)
    want = REGISTRY["sma"].run(spark, str(tmp_path))
    assert want.count() == df.count() == 320
