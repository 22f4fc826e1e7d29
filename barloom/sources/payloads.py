"""Provider JSON payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}


def parse_timeseries(payloads: DataFrame, root: str = "Time Series (Daily)", fields: dict | None = None, time: str = "date") -> DataFrame:
    """{root: {date: {"1. open": "..."}}} per row to bars; a field is named by the text after the dot."""
    series = F.from_json("payload", f"STRUCT<`{root}`: MAP<STRING, MAP<STRING, STRING>>>")[root]
    days = payloads.select("symbol", F.explode(series).alias("d", "f"))
    plain = F.transform_keys("f", lambda k, _: F.element_at(F.split(k, "\\. "), -1))
    df = days.select("symbol", F.col("d").try_cast(time).alias(time), plain.alias("f"))
    return df.select("symbol", time, *[F.col("f")[n].try_cast(ty).alias(n) for n, ty in (fields or FIELDS).items()])


def parse_indicator(payloads: DataFrame, indicator: str, columns: list[str]) -> DataFrame:
    """{"Technical Analysis: X": {date: {X: "..."}}} to one row per date with the named columns."""
    root = f"Technical Analysis: {indicator}"
    series = F.from_json("payload", f"STRUCT<`{root}`: MAP<STRING, MAP<STRING, STRING>>>")[root]
    days = payloads.select("symbol", F.explode(series).alias("d", "f"))
    return days.select("symbol", F.col("d").try_cast("date").alias("date"), *[F.col("f")[c].try_cast("double").alias(c) for c in columns])


NEWS_SHAPES = {
    "feed": ("STRUCT<feed: ARRAY<STRUCT<title: STRING, summary: STRING, url: STRING, source: STRING, time_published: STRING, overall_sentiment_score: DOUBLE>>>",
             lambda x: x["feed"], lambda i: (i["title"], i["summary"], i["url"], i["source"], i["time_published"], i["overall_sentiment_score"])),
    "articles": ("STRUCT<articles: ARRAY<STRUCT<title: STRING, description: STRING, url: STRING, source: STRUCT<name: STRING>, publishedAt: STRING>>>",
                 lambda x: x["articles"], lambda i: (i["title"], i["description"], i["url"], i["source"]["name"], i["publishedAt"], F.lit(None).cast("double"))),
    "list": ("ARRAY<STRUCT<title: STRING, text: STRING, url: STRING, site: STRING, publishedDate: STRING>>",
             lambda x: x, lambda i: (i["title"], i["text"], i["url"], i["site"], i["publishedDate"], F.lit(None).cast("double"))),
}


def parse_news(payloads: DataFrame, shape: str, cutoff=None) -> DataFrame:
    """Provider news to (title, summary, url, source, published_at, sentiment), older items than the cutoff dropped."""
    schema, items, pick = NEWS_SHAPES[shape]
    df = payloads.select(F.explode(items(F.from_json("payload", schema))).alias("i"))
    title, summary, url, source, at, sentiment = pick(F.col("i"))
    when = F.coalesce(F.try_to_timestamp(at, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(at))
    df = df.select(title.alias("title"), summary.alias("summary"), url.alias("url"), source.alias("source"), when.alias("published_at"), sentiment.alias("sentiment"))
    return df if cutoff is None else df.where(F.col("published_at") >= F.lit(cutoff).cast("timestamp"))


CALENDAR = "ARRAY<STRUCT<event: STRING, date: STRING, country: STRING, impact: STRING, actual: STRING, previous: STRING, forecast: STRING, unit: STRING>>"


def parse_calendar(payloads: DataFrame, start=None, end=None) -> DataFrame:
    i = F.col("i")
    df = payloads.select(F.explode(F.from_json("payload", CALENDAR)).alias("i")).select(
        i["event"].alias("event"), i["date"].try_cast("date").alias("date"), i["country"].alias("country"), i["impact"].alias("impact"),
        *[i[c].try_cast("double").alias(c) for c in ("actual", "previous", "forecast")], i["unit"].alias("unit"))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if not end else df.where(F.col("date") <= F.lit(end).cast("date"))


COMPANY = {"Symbol": ("symbol", "string"), "Name": ("name", "string"), "Sector": ("sector", "string"), "MarketCapitalization": ("market_cap", "bigint"),
           "PERatio": ("pe_ratio", "double"), "DividendYield": ("dividend_yield", "double"), "EPS": ("eps", "double")}


def parse_company(payloads: DataFrame) -> DataFrame:
    """String-typed company facts to typed columns; text that is no number becomes null."""
    f = F.from_json("payload", "MAP<STRING, STRING>")
    return payloads.select(f.alias("f")).select(*[F.col("f")[k].try_cast(ty).alias(n) for k, (n, ty) in COMPANY.items()])
