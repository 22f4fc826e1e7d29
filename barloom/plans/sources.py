"""Plans for scans, payloads, upserts, validation, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalars as sc
from barloom.operators import cleaning as cl
from barloom.operators import indicators as ind
from barloom.plans.oracle import W, roll
from barloom.registry import query
from barloom.sources import payloads, readers, stored, upsert
from barloom.sources.tables import Tables

B = "bars"
COLS = ["open", "high", "low", "close", "volume"]


def saved(t: Tables, df, name: str, kind: str = "parquet") -> str:
    return readers.write_files(df, f"{readers.shared_folder(t.spark, name)}.{kind}")


def stored_upsert(t: Tables, base, incoming, keys: list[str], partition, now=None):
    """A stored table of ``base`` with one batch merged into it, read back."""
    path = readers.shared_folder(t.spark, "table")
    stored.create(base, path, partition)
    stored.upsert_table(t.spark, path, incoming, keys, partition, "batch", now)
    return stored.read(t.spark, path)


# ---- scans ----

@query("scan_files", "SELECT 'csv' AS kind, * FROM bars UNION ALL SELECT 'json', * FROM bars UNION ALL SELECT 'parquet', * FROM bars", B)
def _(t: Tables):
    out = None
    for kind in ("csv", "json", "parquet"):
        df = readers.scan_files(t.spark, saved(t, t.stored_bars, "scan", kind), readers.BARS_SCHEMA).withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


@query("scan_bars_range", "SELECT * FROM bars WHERE symbol = 7 AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", B)
def _(t: Tables):
    return readers.scan_bars_range(t.bars, 7, "1996-01-01", "1997-12-31")


@query("scan_bars_batch", """, w AS (SELECT s_suppkey AS symbol FROM supplier UNION SELECT -1), b AS (SELECT * FROM bars WHERE date >= DATE '1997-01-01')
SELECT w.symbol, date, open, high, low, close, volume, CASE WHEN date IS NULL THEN 'error: no data' ELSE 'ok' END AS status FROM w LEFT JOIN b USING (symbol)""", B)
def _(t: Tables):
    wanted = t.raw("supplier").select(F.col("s_suppkey").alias("symbol")).unionByName(t.spark.createDataFrame([(-1,)], "symbol bigint"))
    return readers.scan_bars_batch(t.bars, wanted, "1997-01-01")


TEXT = F.col
BAR_ORDER = ["symbol", "date", *COLS]


def bar_payload(t: Tables, root: str, time: str = "date"):
    fields = F.create_map(*[x for i, c in enumerate(COLS) for x in (F.lit(f"{i + 1}. {c}"), F.col(c).cast("string"))])
    days = F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), fields.alias("f"))))
    return t.bars.groupBy("symbol").agg(F.to_json(F.struct(days.alias(root))).alias("payload"))


@query("parse_timeseries_json", "SELECT * FROM bars", B)
def _(t: Tables):
    root = "Time Series (Daily)"
    return payloads.parse_timeseries(bar_payload(t, root), root).select(*BAR_ORDER)


@query("parse_indicator_json", f"SELECT * FROM (SELECT symbol, date, {roll('avg', 'close', 20)} AS SMA FROM bars) WHERE SMA IS NOT NULL", B, r4="SMA")
def _(t: Tables):
    rows = ind.sma(t.bars, 20).where("sma_20 IS NOT NULL")
    days = F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), F.create_map(F.lit("SMA"), F.col("sma_20").cast("string")).alias("f"))))
    docs = rows.groupBy("symbol").agg(F.to_json(F.struct(days.alias("Technical Analysis: SMA"))).alias("payload"))
    return payloads.parse_indicator(docs, "SMA", ["SMA"])


@query("parse_news_json", """SELECT title, content AS summary, link AS url, source, CAST(published AS TIMESTAMP) AS published_at, CASE WHEN lang = 'en' THEN 0.5 END::DOUBLE AS sentiment
FROM articles WHERE published >= DATE '2024-02-01'""", "articles")
def _(t: Tables):
    a, day = t.articles, F.date_format("published", "yyyyMMdd'T'HHmmss")
    feed = F.struct(F.array(F.struct("title", F.col("content").alias("summary"), F.col("link").alias("url"), "source", day.alias("time_published"),
                                     F.lit(0.5).alias("overall_sentiment_score"))).alias("feed"))
    arts = F.struct(F.array(F.struct("title", F.col("content").alias("description"), F.col("link").alias("url"), F.struct(F.col("source").alias("name")).alias("source"),
                                     F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))).alias("articles"))
    lst = F.array(F.struct("title", F.col("content").alias("text"), F.col("link").alias("url"), F.col("source").alias("site"),
                           F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("publishedDate")))
    parts = [(a.where("lang = 'en'"), feed, "feed"), (a.where("lang = 'fr'"), arts, "articles"), (a.where("lang NOT IN ('en', 'fr')"), lst, "list")]
    out = None
    for src, doc, shape in parts:
        df = payloads.parse_news(src.select(F.to_json(doc).alias("payload")), shape, "2024-02-01")
        out = df if out is None else out.unionByName(df)
    return out


@query("parse_calendar_json", """SELECT event_type || ' ' || event_id AS event, CAST(ts AS DATE) AS date, 'US' AS country, CASE WHEN value > 50 THEN 'High' ELSE 'Low' END AS impact,
  value AS actual, CAST(NULL AS DOUBLE) AS previous, value * 2 AS forecast, '%' AS unit FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""", r6="forecast")
def _(t: Tables):
    v = F.col("value")
    item = F.array(F.struct(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("event"), F.col("ts").cast("date").cast("string").alias("date"),
                            F.lit("US").alias("country"), F.when(v > 50, "High").otherwise("Low").alias("impact"), v.cast("string").alias("actual"),
                            F.lit("n/a").alias("previous"), (v * 2).cast("string").alias("forecast"), F.lit("%").alias("unit")))
    return payloads.parse_calendar(t.raw("events").select(F.to_json(item).alias("payload")), "2024-01-05", "2024-01-25")


@query("parse_company_json", """SELECT CAST(symbol AS VARCHAR) AS symbol, name, sector, CAST(floor(balance * 1000) AS BIGINT) AS market_cap, CAST(NULL AS DOUBLE) AS pe_ratio,
  0.01::DOUBLE AS dividend_yield, balance AS eps FROM securities""", "securities")
def _(t: Tables):
    m = F.create_map(F.lit("Symbol"), F.col("symbol").cast("string"), F.lit("Name"), F.col("name"), F.lit("Sector"), F.col("sector"),
                     F.lit("MarketCapitalization"), F.floor(F.col("balance") * 1000).cast("string"), F.lit("PERatio"), F.lit("None"),
                     F.lit("DividendYield"), F.lit("0.01"), F.lit("EPS"), F.col("balance").cast("string"))
    return payloads.parse_company(t.securities.select(F.to_json(m).alias("payload")))


@query("symbol_search", """SELECT symbol, name, 1 - levenshtein(lower(name), 'supplier#00000001')::DOUBLE / greatest(length(name), 17) AS match_score FROM securities
WHERE contains(lower(name), 'supplier#00000001') ORDER BY match_score DESC, symbol LIMIT 20""", "securities", r6="match_score")
def _(t: Tables):
    return readers.symbol_search(t.securities, "Supplier#00000001")


@query("read_through", "SELECT * FROM bars", B)
def _(t: Tables):
    return readers.read_through(t.bars.where("date < '1998-01-01'"), t.bars, ["symbol", "date"])


@query("upsert_bars", """SELECT symbol, date, open, high, low, CASE WHEN date >= DATE '1998-01-01' THEN close * 2 ELSE close END AS close, volume,
  CASE WHEN date >= DATE '1998-01-01' THEN TIMESTAMP '2024-01-02 00:00:00' END AS updated_at FROM bars""", B)
def _(t: Tables):
    newer = t.bars.where("date >= '1998-01-01'").withColumn("close", F.col("close") * 2)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return stored_upsert(t, t.bars, newer, ["symbol", "date"], F.year("date"), now).select(*BAR_ORDER, "updated_at")


@query("upsert_indicators", f""", i AS (SELECT symbol, date, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50 FROM bars)
SELECT symbol, 'sma_20' AS indicator, date, CASE WHEN date >= DATE '1998-01-01' THEN -1 ELSE sma_20 END AS value FROM i WHERE sma_20 IS NOT NULL
UNION ALL SELECT symbol, 'sma_50', date, CASE WHEN date >= DATE '1998-01-01' THEN -1 ELSE sma_50 END FROM i WHERE sma_50 IS NOT NULL""", B, r4="value")
def _(t: Tables):
    means = ind.sma(ind.sma(t.bars, 20), 50).select("symbol", "date", "sma_20", "sma_50")
    long = upsert.indicators_long(readers.materialize(means, "means"), ["sma_20", "sma_50"])  # the table and the batch both start from it
    newer = long.where("date >= '1998-01-01'").withColumn("value", F.lit(-1.0))
    return stored_upsert(t, long, newer, ["symbol", "indicator", "date"], F.year("date"))


@query("upsert_news_events", """SELECT user_id AS symbol, CASE WHEN event_type = 'view' THEN 't:' || strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE CAST(event_id AS VARCHAR) END AS k, max(value) AS value
FROM (SELECT *, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS g FROM events) GROUP BY 1, 2""")
def _(t: Tables):
    ev = t.raw("events").select(F.col("user_id").alias("symbol"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("event_id"),
                                F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value")
    rows = ev.select("symbol", upsert.event_key("event_id", "at").alias("k"), "value")
    base = rows.where("value < 10").groupBy("symbol", "k").agg(F.max("value").alias("value"))
    return stored_upsert(t, base, rows.where("value >= 10"), ["symbol", "k"], F.pmod(F.xxhash64("symbol"), F.lit(8)))


@query("upsert_by_key", """, a AS (SELECT symbol, 'overview' AS type, name FROM securities), b AS (SELECT symbol, 'overview' AS type, upper(name) AS name FROM securities WHERE balance > 0)
SELECT symbol, type, coalesce(b.name, a.name) AS name FROM a LEFT JOIN b USING (symbol, type)""", "securities")
def _(t: Tables):
    a = t.securities.select("symbol", F.lit("overview").alias("type"), "name")
    b = t.securities.where("balance > 0").select("symbol", F.lit("overview").alias("type"), F.upper("name").alias("name"))
    return stored_upsert(t, a, b, ["symbol", "type"], F.pmod(F.xxhash64("symbol"), F.lit(8)))


@query("update_delete_where", "SELECT symbol, date, CASE WHEN close > 105 THEN 0 ELSE volume END AS volume FROM bars WHERE NOT (close < 95)", B)
def _(t: Tables):
    df = upsert.update_where(t.bars, F.col("close") > 105, {"volume": F.lit(0).cast("bigint")})
    return upsert.delete_where(df, F.col("close") < 95).select("symbol", "date", "volume")


@query("ingest_all", f"""SELECT 'bars' AS dataset, count(*) AS rows FROM bars UNION ALL SELECT 'company', count(*) FROM securities
UNION ALL SELECT 'indicators', count(*) FROM (SELECT {roll('avg', 'close', 20)} AS s FROM bars) WHERE s IS NOT NULL""", "bars securities", stored=True)
def _(t: Tables):
    bars = t.bars
    parts = {"bars": bars, "company": t.spark.read.parquet(saved(t, t.securities, "company")),
             "indicators": t.spark.read.parquet(saved(t, upsert.indicators_long(ind.sma(bars, 20), ["sma_20"]), "indicators"))}
    out = None
    for name, df in parts.items():
        n = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("save_load_named", "SELECT * FROM bars", B)
def _(t: Tables):
    return t.spark.read.parquet(saved(t, t.bars, "named"))


@query("write_predictions", "SELECT model, symbol, date, y_true, y_pred, y_pred - y_true AS error FROM predictions", "predictions", r4="y_pred error")
def _(t: Tables):
    df = t.predictions.select("model", "symbol", "date", "y_true", "y_pred").withColumn("error", F.col("y_pred") - F.col("y_true"))
    return readers.scan_files(t.spark, saved(t, df, "predictions", "csv"), "model string, symbol bigint, date date, y_true double, y_pred double, error double")


@query("split_dataset", """, i AS (SELECT symbol, date, row_number() OVER (ORDER BY date, symbol) - 1 AS row_index, count(*) OVER () AS n FROM bars)
SELECT symbol, date, row_index, CAST(least(row_index // (n // 7), 6) AS INTEGER) AS chunk FROM i""", B)
def _(t: Tables):
    return readers.split_dataset(t.stored_bars.select("symbol", "date"), 7, "date", ["symbol"])


@query("dataset_profile", """SELECT count(*) AS row_count, 7 AS column_count, min(date) AS start_date, max(date) AS end_date, false AS has_missing, avg(close) AS close_mean, stddev_samp(close) AS close_std, min(close) AS close_min,
  max(close) AS close_max, avg(volume) AS volume_mean, stddev_samp(volume) AS volume_std, min(volume) AS volume_min, max(volume) AS volume_max FROM bars""", B, r6="close_mean close_std volume_mean volume_std")
def _(t: Tables):
    return readers.dataset_profile(t.bars, ["close", "volume"])


@query("dataset_version_diff", """SELECT count(*) AS rows_old, count_if(volume >= 20) AS rows_new, 0::BIGINT AS rows_added, count_if(volume < 20) AS rows_removed,
  count_if(volume >= 20 AND close > 100) AS rows_changed, 'ret' AS columns_added, 'open' AS columns_removed FROM bars""", B)
def _(t: Tables):
    new = t.bars.where("volume >= 20").drop("open").withColumns({"ret": F.lit(0.0), "high": F.when(F.col("close") > 100, F.col("high") + 1).otherwise(F.col("high"))})
    return readers.dataset_version_diff(t.bars, new, ["symbol", "date"])


# ---- validation and cleaning ----

DIRTY = """dirty AS (SELECT symbol, date, CASE WHEN volume > 60 THEN NULL ELSE open END AS open, high, CASE WHEN close < 92 THEN -low ELSE low END AS low, close,
  CASE WHEN close > 110 THEN -volume ELSE volume END AS volume, CASE WHEN volume > 30 THEN 'A' || (volume % 3) END AS grade FROM bars)"""


def dirty(t: Tables):
    """Bars with nulls, negative prices and negative volumes put in by value rules."""
    c, v = F.col("close"), F.col("volume")
    return t.bars.select("symbol", "date", F.when(~(v > 60), F.col("open")).alias("open"), "high", F.when(c < 92, -F.col("low")).otherwise(F.col("low")).alias("low"),
                         "close", F.when(c > 110, -v).otherwise(v).alias("volume"), F.when(v > 30, F.concat(F.lit("A"), (v % 3).cast("string"))).alias("grade"))


VB = [("open_positive", "NOT coalesce(open > 0, false)"), ("high_positive", "NOT coalesce(high > 0, false)"), ("low_positive", "NOT coalesce(low > 0, false)"),
      ("close_positive", "NOT coalesce(close > 0, false)"), ("volume_not_negative", "NOT coalesce(volume >= 0, false)")]


@query("validate_bars", f", {DIRTY} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(count_if({c}) AS BIGINT) AS violations, count(*) AS rows FROM dirty" for r, c in VB), B)
def _(t: Tables):
    return cl.validate_bars(dirty(t))


@query("validate_returns", "SELECT symbol, count(*) AS rows, CAST(count_if(abs(ret) > 1) AS BIGINT) AS violations, count_if(abs(ret) > 1) = 0 AS valid FROM returns GROUP BY 1", "returns")
def _(t: Tables):
    return cl.validate_returns(t.returns)


@query("validate_portfolio", """SELECT portfolio_id, count(*) AS assets, sum(weight) AS total_weight, CAST(count_if(weight < 0 OR weight > 1) AS BIGINT) AS out_of_range, 0::BIGINT AS missing_fields,
  sum(weight) BETWEEN 0.99 AND 1.01 AND count_if(weight < 0 OR weight > 1) = 0 AS valid FROM weights GROUP BY 1""", "weights", r6="total_weight")
def _(t: Tables):
    return cl.validate_portfolio(t.weights)


@query("validate_indicator", f""", i AS (SELECT {roll('avg', 'close', 20)} AS s, close - 90 AS r FROM bars)
SELECT 'SMA' AS indicator, count(*) AS rows, CAST(count_if(s <= 0) AS BIGINT) AS violations FROM i WHERE s IS NOT NULL UNION ALL SELECT 'RSI', count(*), CAST(count_if(r < 0 OR r > 100) AS BIGINT) FROM i""", B)
def _(t: Tables):
    sma = ind.sma(t.bars, 20).where("sma_20 IS NOT NULL").select(F.lit("SMA").alias("indicator"), F.col("sma_20").alias("value"))
    return cl.validate_indicator(sma.unionByName(t.bars.select(F.lit("RSI").alias("indicator"), (F.col("close") - 90).alias("value"))))


@query("check_integrity", f", {DIRTY} SELECT count(*) AS row_count, CAST(count_if(open IS NULL) AS BIGINT) AS null_count, 'adjusted' AS missing_columns, false AS valid FROM dirty", B)
def _(t: Tables):
    return cl.check_integrity(dirty(t), ["open", "close", "adjusted"])


@query("clean_bars", f", {DIRTY} SELECT *, coalesce(least(open, high, low, close) <= 0 OR volume < 0, false) AS suspect FROM dirty WHERE open IS NOT NULL", B)
def _(t: Tables):
    return cl.clean_bars(dirty(t))


@query("clean_quarterly", f", {DIRTY} SELECT * FROM dirty WHERE open IS NOT NULL AND grade IS NOT NULL", B)
def _(t: Tables):
    return cl.clean_quarterly(dirty(t))


@query("clean_shareholding", f", {DIRTY} SELECT * FROM dirty WHERE open IS NOT NULL OR grade IS NOT NULL", B)
def _(t: Tables):
    return cl.clean_shareholding(dirty(t), ["open", "grade"])


@query("clean_news", """SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, url FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '' AND trim(url) <> ''""")
def _(t: Tables):
    return cl.clean_news(t.raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url"))


FF = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"


@query("fill_median_ffill", f""", {DIRTY} SELECT symbol, date, coalesce(open, (SELECT median(open) FROM dirty)) AS open, high, low, close, volume,
  coalesce(last_value(grade IGNORE NULLS) {FF}, first_value(grade IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS grade FROM dirty""", B, r6="open")
def _(t: Tables):
    return cl.fill_median_ffill(readers.materialize(dirty(t)), ["open"], ["grade"])


@query("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def _(t: Tables):
    return cl.drop_duplicates(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


QT = ", q AS (SELECT quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS b, quantile_cont(volume, 0.25) AS c, quantile_cont(volume, 0.75) AS d FROM bars)"


@query("clip_iqr", f"""{QT} SELECT symbol, date, least(greatest(close, a - 0.5 * (b - a)), b + 0.5 * (b - a)) AS close, least(greatest(volume, c - 0.5 * (d - c)), d + 0.5 * (d - c))::DOUBLE AS volume FROM bars, q""", B, r6="close volume")
def _(t: Tables):
    return cl.clip_iqr(t.stored_bars.select("symbol", "date", "close", "volume"), ["close", "volume"], 0.5)


@query("minmax_scale", "SELECT symbol, date, (close - min(close) OVER ()) / (max(close) OVER () - min(close) OVER ()) AS close FROM bars", B, r9="close")
def _(t: Tables):
    return cl.minmax_scale(t.stored_bars.select("symbol", "date", "close"), ["close"])


@query("standard_scale", "SELECT symbol, date, (close - (SELECT avg(close) FROM bars WHERE date < DATE '1999-01-01')) / (SELECT stddev_pop(close) FROM bars WHERE date < DATE '1999-01-01') AS close FROM bars", B, r6="close")
def _(t: Tables):
    df = t.stored_bars.select("symbol", "date", "close")
    return cl.standard_scale(df, ["close"], df.where("date < '1999-01-01'"))


ZS = "SELECT symbol, date, close, volume, abs((close - avg(close) OVER ()) / stddev_pop(close) OVER ()) >= 2 OR abs((volume - avg(volume) OVER ()) / stddev_pop(volume) OVER ()) >= 2 AS is_outlier FROM bars"


@query("remove_outliers_zscore", f"SELECT symbol, date, close, volume FROM ({ZS}) WHERE NOT is_outlier", B)
def _(t: Tables):
    return cl.remove_outliers(t.stored_bars.select("symbol", "date", "close", "volume"), ["close", "volume"], "zscore", 2.0)


IQ = f"{QT}, f AS (SELECT symbol, date, close, volume, close < a - 1.5 * (b - a) OR close > b + 1.5 * (b - a) OR volume < c - 1.5 * (d - c) OR volume > d + 1.5 * (d - c) AS is_outlier FROM bars, q)"


@query("remove_outliers_iqr", f"{IQ} SELECT symbol, date, close, volume FROM f WHERE NOT is_outlier", B)
def _(t: Tables):
    return cl.remove_outliers(t.stored_bars.select("symbol", "date", "close", "volume"), ["close", "volume"], "iqr")


@query("flag_anomalies_global", f"{IQ} SELECT f.*, z.is_outlier AS z_outlier FROM f JOIN ({ZS}) z USING (symbol, date)", B)
def _(t: Tables):
    df = cl.outlier_flag(t.stored_bars.select("symbol", "date", "close", "volume"), ["close", "volume"], "iqr")
    return cl.outlier_flag(df, ["close", "volume"], "zscore", 2.0, "z_outlier")


@query("feature_chain", f""", z AS ({ZS}) SELECT 0 AS step_no, 'scale' AS step, count(*) AS rows FROM z UNION ALL SELECT 1, 'outliers', CAST(count_if(NOT is_outlier) AS BIGINT) FROM z UNION ALL SELECT 2, 'custom', CAST(count_if(NOT is_outlier) AS BIGINT) FROM z""", B)
def _(t: Tables):
    df = t.stored_bars.select("symbol", "date", "close", "volume")
    steps = [("scale", lambda d: cl.standard_scale(d, ["close"])), ("outliers", lambda d: cl.remove_outliers(d, ["close", "volume"], "zscore", 2.0)),
             ("custom", lambda d: d.withColumn("turnover", F.col("close") * F.col("volume")))]
    return cl.feature_chain(df, steps)[1]


@query("smote_balance")
def _(t: Tables):
    df = t.raw("labels").join(t.raw("documents"), "doc_id").select("doc_id", "quality", "n_chars", F.size(F.split("text", "\\s+")).alias("n_words"))
    return cl.smote_balance(readers.materialize(df), "doc_id", "quality", ["n_chars", "n_words"])


# ---- scalars ----

@query("sanitize_text", r"""SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N} _\-.,;:!?()\[\]{}''"/\\@#$%^&*+=<>]', '', 'g') AS clean FROM documents""")
def _(t: Tables):
    return t.raw("documents").select("doc_id", sc.sanitize_text("text", None).alias("clean"))


@query("format_currency", """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(s_acctbal)) AS usd, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || '€' || format('{:,.2f}', abs(s_acctbal)) AS eur FROM supplier""")
def _(t: Tables):
    return t.raw("supplier").select("s_suppkey", sc.format_currency("s_acctbal").alias("usd"), sc.format_currency("s_acctbal", "EUR").alias("eur"))


@query("format_number_pct", "SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS amount, printf('%.2f', l_discount * 100) || '%' AS pct FROM lineitem")
def _(t: Tables):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", sc.format_number("l_extendedprice").alias("amount"), sc.format_percentage("l_discount").alias("pct"))


@query("safe_divide", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS v FROM lineitem")
def _(t: Tables):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", sc.safe_divide("l_tax", "l_discount").alias("v"))


@query("decay_weights", """, w AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) SELECT symbol, sum(close * pow(0.5, k - 1) / (2 - pow(0.5, 4))) AS weighted FROM w WHERE k <= 5 GROUP BY 1""", B, r4="weighted")
def _(t: Tables):
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("date", "close")))), 1, 5)  # a series is calendar-bounded
    df = t.bars.groupBy("symbol").agg(newest.alias("v"))
    total = F.aggregate(F.zip_with("v", sc.decay_weights(5, 0.5), lambda a, w: a["close"] * w), F.lit(0.0), lambda a, b: a + b)
    return df.select("symbol", total.alias("weighted"))


@query("rolling_matrix", """SELECT vec_id, len(embedding) - 59 AS n_rows, list_sum(embedding[1:60])::DOUBLE AS first_sum, list_sum(embedding[5:64])::DOUBLE AS last_sum FROM embeddings""", r4="first_sum last_sum")
def _(t: Tables):
    df = t.raw("embeddings").select("vec_id", sc.rolling_matrix("embedding", 60).alias("m"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return df.select("vec_id", F.size("m").cast("bigint").alias("n_rows"), total(F.col("m")[0]).alias("first_sum"), total(F.element_at("m", -1)).alias("last_sum"))


@query("valuation", """SELECT symbol, close / greatest(volume / 100.0, 0.01) AS pe_ratio, close / greatest(open, 0.01) AS pb_ratio, date FROM bars""", B, r6="pe_ratio pb_ratio")
def _(t: Tables):
    return t.bars.withColumns(sc.valuation("close", F.col("volume") / 100.0, "open")).select("symbol", "date", "pe_ratio", "pb_ratio")
