"""Plans that drain a stream over the test tables and return its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.plans.oracle import W, roll
from barloom.registry import query
from barloom.sources.readers import materialize, shared_folder
from barloom.sources.tables import Tables
from barloom.streaming import jobs

TS = "CAST(ts AS TIMESTAMP)"


def ticks(t: Tables):
    return jobs.read_ticks(t.spark, t.dir)


def plain(df, *cols):
    """Window bounds as time without zone, as in the source table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_bars", """SELECT user_id AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def _(t: Tables):
    return plain(jobs.run(jobs.stream_bars(ticks(t)), "stream_bars", "update", ["symbol", "start"]), "start")


@query("stream_rolling", """WITH e AS (SELECT user_id AS symbol, ts, value, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM events),
w AS (SELECT symbol, b AS start, value FROM e UNION ALL SELECT symbol, b - INTERVAL 3 HOUR, value FROM e)
SELECT symbol, start, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM w GROUP BY 1, 2""", r6="mean std")
def _(t: Tables):
    return plain(jobs.run(jobs.stream_rolling(ticks(t)), "stream_rolling", "update", ["symbol", "start"]), "start")


@query("stream_sessions", """WITH e AS (SELECT user_id AS symbol, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events, sum(value) AS total FROM s GROUP BY symbol, sid
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", r6="total")
def _(t: Tables):
    return plain(jobs.run(jobs.stream_sessions(ticks(t)), "stream_sessions", "append"), "start", "end")


RULES = [jobs.Rule("high", "above", 108.0), jobs.Rule("low", "below", 92.0), jobs.Rule("par", "crossing", 100.0), jobs.Rule("busy", "above", 60, "volume"),
         jobs.Rule("mean", "crossing", 100.0, "sma_20"), jobs.Rule("one", "below", 97.0, "close", 1), jobs.Rule("off", "above", 0.0, is_active=False)]
#: The second delivery starts here and brings the bars since AGAIN once more.
SECOND, AGAIN = "1998-07-01", "1998-01-01"


def fired(rule: str, field: str, where: str) -> str:
    return f"SELECT symbol, date, '{rule}' AS rule, '{field}' AS field, {field} AS value, was_{field} AS previous FROM p WHERE {where}"


ALERTS = " UNION ALL ".join([
    fired("high", "close", "close > 108"), fired("low", "close", "close < 92"), fired("par", "close", "(was_close - 100) * (close - 100) < 0"),
    fired("busy", "volume", "volume > 60"), fired("mean", "sma_20", "(was_sma_20 - 100) * (sma_20 - 100) < 0"), fired("one", "close", "symbol = 1 AND close < 97")])


@query("stream_alerts", f""", x AS (SELECT symbol, date, close, CAST(volume AS DOUBLE) AS volume, {roll('avg', 'close', 20)} AS sma_20 FROM bars),
p AS (SELECT *, lag(close) OVER ({W}) AS was_close, lag(volume) OVER ({W}) AS was_volume, lag(sma_20) OVER ({W}) AS was_sma_20 FROM x),
a AS ({ALERTS})
SELECT symbol, date, rule, field, value, previous, lag(date) OVER (PARTITION BY symbol, rule ORDER BY date) AS last_triggered, false AS late FROM a
UNION ALL SELECT symbol, date, NULL, NULL, NULL, NULL, NULL, true FROM bars WHERE date >= DATE '{AGAIN}' AND date < DATE '{SECOND}'""", "bars", r6="value previous")
def _(t: Tables):
    """Bars in two deliveries, the second with bars of the first; the stream stops after the first and goes on from its checkpoint."""
    folder, base = shared_folder(t.spark, "bar-feed"), shared_folder(t.spark, "alerts")
    bars = materialize(indicators.sma(t.bars, 20).select("symbol", "date", "close", F.col("volume").cast("double").alias("volume"), "sma_20"), "bars")
    for part in (F.col("date") < SECOND, F.col("date") >= AGAIN):
        bars.where(part).write.mode("append").parquet(folder)
        feed = t.spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 64).parquet(folder)
        out = jobs.run(jobs.stream_alerts(feed, RULES), "alerts", "append", base=base)
    return out


@query("stream_upsert_news", "SELECT DISTINCT md5(content) AS id, title FROM articles", "articles")
def _(t: Tables):
    docs = jobs.read_files(t.spark, t.dir, "documents.parquet", "doc_id bigint, text string")
    title = F.substring_index("text", "\n", 1)
    published = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp")
    items = docs.select(F.md5("text").alias("id"), title.alias("title"), published.alias("published_at"))
    return jobs.run(jobs.stream_news(items), "stream_news", "append", ["id"]).select("id", "title")
