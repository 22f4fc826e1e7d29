"""Sentiment and event aggregates over news(symbol, date, source, sentiment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import prev, rate

POSITIVE, NEGATIVE = 0.3, -0.3


def sentiment_class(s: str = "sentiment") -> Column:
    return F.when(F.col(s) > POSITIVE, "positive").when(F.col(s) < NEGATIVE, "negative").otherwise("neutral")


def _counts() -> list[Column]:
    s = F.col("sentiment")
    return [F.count_if(s > POSITIVE).alias("positive_count"), F.count_if(s < NEGATIVE).alias("negative_count"),
            F.count_if((s >= NEGATIVE) & (s <= POSITIVE)).alias("neutral_count")]


def news_summary(news: DataFrame, as_of: Column, recent_days: int = 3) -> DataFrame:
    """Counts, mean, population std and recent-minus-earlier trend per symbol."""
    s = F.col("sentiment")
    recent = F.datediff(as_of, "date") <= recent_days
    df = news.withColumn("_recent", recent)
    out = df.groupBy("symbol").agg(
        F.count("*").alias("news_count"), F.avg(s).alias("average_sentiment"), F.stddev_pop(s).alias("sentiment_std"), *_counts(),
        F.avg(F.when(F.col("_recent"), s)).alias("_r"), F.avg(F.when(~F.col("_recent"), s)).alias("_e"))
    trend = F.when(F.col("news_count") > recent_days, st.zero_if_null(F.col("_r")) - st.zero_if_null(F.col("_e"))).otherwise(0.0)
    return out.withColumn("sentiment_trend", trend).drop("_r", "_e")


def social_summary(news: DataFrame) -> DataFrame:
    """Mention-weighted sentiment over platforms and the bullish percentage."""
    per = news.groupBy("symbol", "source").agg(F.avg("sentiment").alias("s"), F.count("*").alias("m"))
    out = per.groupBy("symbol").agg(F.sum("m").alias("total_mentions"), F.count("*").alias("platforms"),
                                    st.ratio(F.sum(F.col("s") * F.col("m")), F.sum("m")).alias("overall_sentiment"))
    return out.withColumn("bullish_percentage", (F.col("overall_sentiment") + 1) * 50)


def iso_week_label(d: str = "date") -> Column:
    """Year and ISO week such as 2024-W05; the year is that of the week's Thursday."""
    thursday = F.date_add(F.col(d), 3 - F.weekday(d))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def news_trends(news: DataFrame, grouping: str = "day") -> DataFrame:
    label = {"day": F.date_format("date", "yyyy-MM-dd"), "week": iso_week_label(), "month": F.date_format("date", "yyyy-MM")}[grouping]
    return news.groupBy(label.alias("period")).agg(F.count("*").alias("article_count"), F.avg("sentiment").alias("average_sentiment"), *_counts())


def compare_coverage(news: DataFrame) -> DataFrame:
    out = news.groupBy("symbol").agg(F.count("*").alias("article_count"), F.avg("sentiment").alias("average_sentiment"), *_counts())
    return out.withColumn("sentiment_ratio", F.col("positive_count").cast("double") / F.greatest(F.col("negative_count"), F.lit(1)))


def sentiment_price_join(bars: DataFrame, news: DataFrame) -> DataFrame:
    """Returns beside the previous news day's mean sentiment of the symbol."""
    daily = news.groupBy("symbol", "date").agg(F.avg("sentiment").alias("s"))
    lagged = daily.select("symbol", "date", prev("s").alias("sentiment"))
    rets = bars.select("symbol", "date", rate("close").alias("ret"))
    return rets.join(lagged, ["symbol", "date"], "left").where("ret IS NOT NULL AND sentiment IS NOT NULL")


def sentiment_impact(joined: DataFrame) -> DataFrame:
    s, r = F.col("sentiment"), F.col("ret")
    up, down = s > POSITIVE, s < NEGATIVE
    calls = F.count_if(up | down)
    out = joined.groupBy("symbol").agg(
        F.corr("ret", "sentiment").alias("correlation"), st.zero_if_null(F.avg(F.when(up, r))).alias("avg_return_after_positive"),
        st.zero_if_null(F.avg(F.when(down, r))).alias("avg_return_after_negative"),
        st.zero_if_null(F.avg(F.when(~(up | down), r))).alias("avg_return_after_neutral"),
        st.ratio(F.count_if((up & (r > 0)) | (down & (r < 0))).cast("double") * 100, calls).alias("sentiment_accuracy"), F.count("*").alias("data_points"))
    return out


def earnings_surprises(earnings: DataFrame, periods: int = 8) -> DataFrame:
    """Beats, misses and mean surprise of the newest ``periods`` actuals per symbol."""
    newest = W.partitionBy("symbol").orderBy(F.desc("date"))
    df = earnings.where("eps_actual IS NOT NULL AND eps_estimate IS NOT NULL").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= periods)
    d = F.col("eps_actual") - F.col("eps_estimate")
    out = df.groupBy("symbol").agg(F.count("*").alias("periods_analyzed"), F.count_if(d > 0).alias("beat_count"), F.count_if(d < 0).alias("miss_count"),
                                   F.count_if(d == 0).alias("meet_count"), F.avg(F.try_divide(d, F.abs("eps_estimate")) * 100).alias("average_surprise_pct"))
    return out.withColumn("beat_percentage", F.col("beat_count") / F.col("periods_analyzed") * 100)


def events_calendar(events: DataFrame, kinds, start, end, today) -> DataFrame:
    """Events of the wanted types inside a date range with a flag for the ones still ahead."""
    d = F.col("date")
    return events.where(F.col("type").isin(*kinds) & d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn(
        "is_estimate", d > F.lit(today).cast("date"))


# Phrases that select general market news.
MARKET_PHRASES = ["stock market", "wall street", "nasdaq", "dow jones", "S&P 500", "federal reserve", "interest rates", "inflation",
                  "market outlook", "economic data", "market analysis"]


def market_news(items: DataFrame, phrases=None, limit: int = 100) -> DataFrame:
    """Items whose title or content names a market phrase, exact titles once, newest first."""
    words = "(?i)" + "|".join(p.replace("&", "\\&") for p in (phrases or MARKET_PHRASES))
    hit = items.where(F.concat_ws(" ", "title", "content").rlike(words))
    rest = [c for c in items.columns]
    first = hit.groupBy(F.lower("title").alias("_t")).agg(F.min_by(F.struct(*rest), F.struct("published", "id")).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in rest]).orderBy(F.desc("published"), "id").limit(limit)
