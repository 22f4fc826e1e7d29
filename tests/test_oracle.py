"""Registered queries against their SQL.  A sample by default; BARLOOM_ALL=1 runs every query."""

import os

import __spark_entry__ as entry
import harness
import pytest

SF = os.environ.get("BARLOOM_SF", "/root/testdata/sf0.001")
SAMPLE = """sma ema_adjusted macd rsi bollinger adx obv ichimoku date_parts rolling_features model_features_b sequences market_events trend_class
signal_effectiveness iqr_anomaly lof_anomaly seasonal_decompose performance_calendar max_drawdown_dates drawdown_profile tail_risk portfolio_statistics
correlation_matrix find_pairs portfolio_risk scenario_stress rebalance_trades exposures holdings_pnl peer_compare news_summary sentiment_impact market_news
parse_timeseries_json parse_news_json upsert_bars split_dataset dataset_version_diff validate_bars fill_median_ffill clip_iqr remove_outliers_zscore
strategy_backtest evaluate_model ensemble_direction expand_query decompose_query chunk_fixed chunk_words html_to_text dedup_near knn_filtered build_context
extract_sentences stream_bars stream_alerts""".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CHOSEN = sorted(SQL) if os.environ.get("BARLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    message, _, ok = harness.compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
