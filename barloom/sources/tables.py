"""Market-shaped tables derived from the driver's parquet files.

Every table is lazy.  Bars are built with mergeable aggregates (``min_by`` / ``max_by`` on the tick order)
instead of a window over ticks, so one symbol that owns a third of all ticks is still combined map-side and
the result holds at most one row per (symbol, day): from there on a symbol's series is bounded by the
calendar, not by the data volume.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.frames import series
from barloom.sources.readers import materialize


def daily_bars(ticks: DataFrame, price: str, volume, key) -> DataFrame:
    """OHLCV per (symbol, date) of ticks, first and last by the ``key``.

    A decimal key keeps the whole aggregate in hash buffers; a struct key would force a sort of the ticks.
    """
    return ticks.groupBy("symbol", "date").agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        volume.cast("bigint").alias("volume"),
    )


# The sample questions.
SAMPLE_QUESTIONS = [
    "Is AAPL still ahead of its price of last year?",
    "Which way did the stock market turn this week?",
    "Do higher rates from the Fed weigh on tech stocks?",
    "Can Tesla sell more cars while rivals cut their prices?",
    "Why does inflation reach the makers of consumer goods so late?",
]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
        price = 100 * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) + F.col("l_extendedprice") / 99991
        return (
            self.raw("lineitem")
            .select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"),
                    F.col("l_suppkey").alias("symbol"), price.alias("price"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .drop("o_orderkey")
        )

    @cached_property
    def bars(self) -> DataFrame:
        place = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**11).cast("decimal(12,0)")
        line = F.col("l_linenumber").cast("decimal(2,0)") * F.lit(10**10).cast("decimal(11,0)")
        key = place + line + F.round(F.col("price") * 1e7).cast("decimal(11,0)")
        return daily_bars(self.ticks.withColumn("key", key), "price", F.sum("qty"), "key")

    @cached_property
    def stored_bars(self) -> DataFrame:
        """Bars written once to the shared folder, for operators that pass over their input several times."""
        return materialize(self.bars, "bars")

    def store(self) -> Tables:
        """Lets every later table of this object start from the stored bars."""
        self.__dict__["bars"] = self.stored_bars
        return self

    @cached_property
    def returns(self) -> DataFrame:
        ret = F.try_divide(F.col("close"), F.lag("close").over(series())) - 1
        return self.bars.select("symbol", "date", ret.alias("ret")).where("ret IS NOT NULL")

    @cached_property
    def benchmark(self) -> DataFrame:
        """Mean return of all symbols per date, under one series name."""
        return self.returns.groupBy("date").agg(F.avg("ret").alias("ret"))

    @cached_property
    def news(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "ts",
            F.col("event_type").alias("source"), (2 * k / 99 - 1).alias("sentiment"), "value")

    @cached_property
    def event_bars(self) -> DataFrame:
        ticks = self.raw("events").select(
            F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "ts", "event_id", "value")
        return daily_bars(ticks, "value", F.count("*"), F.struct("ts", "event_id"))

    @cached_property
    def securities(self) -> DataFrame:
        """Symbol facts; nation and region are fixed lists, so Spark broadcasts them by size."""
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("sector"), F.col("r_name").alias("asset_class"),
                    F.col("s_acctbal").alias("balance"))
        )

    @cached_property
    def weights(self) -> DataFrame:
        """Portfolio 1 holds every symbol equally, portfolio 2 by share of total volume."""
        per_symbol = self.bars.groupBy("symbol").agg(F.sum("volume").alias("v"))
        both = per_symbol.withColumns({"n": per_symbol.agg(F.count("*")).scalar(), "tv": per_symbol.agg(F.sum("v")).scalar()})
        split = F.explode(F.array(
            F.struct(F.lit(1).alias("portfolio_id"), (F.lit(1.0) / F.col("n")).alias("weight")),
            F.struct(F.lit(2).alias("portfolio_id"), (F.col("v").cast("double") / F.col("tv")).alias("weight"))))
        return both.select("symbol", split.alias("p")).select("p.portfolio_id", "symbol", "p.weight")

    @cached_property
    def portfolio_series(self) -> DataFrame:
        """Weighted return per portfolio and date, missing returns as zero; ``symbol`` is the portfolio."""
        joined = self.returns.join(self.weights, "symbol")
        return joined.groupBy(F.col("portfolio_id").alias("symbol"), "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))

    @cached_property
    def holdings(self) -> DataFrame:
        freq = F.element_at(F.array(*[F.lit(x) for x in ("annual", "semi_annual", "quarterly", "monthly")]),
                            (F.col("symbol") % 4 + 1).cast("int"))
        return (
            self.bars.groupBy("symbol").agg(
                F.sum("volume").cast("double").alias("quantity"),
                F.min_by("close", "date").alias("purchase_price"),
                F.min("date").alias("purchase_date"),
                F.max_by("close", "date").alias("current_price"))
            .withColumn("dividend_yield", (F.col("symbol") % 5).cast("double"))
            .withColumn("frequency", freq)
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Three naive one-step forecasts of the close: last value, 5-row mean and 10-row mean."""
        models = {"mean10": F.avg("close").over(series().rowsBetween(-10, -1)),
                  "mean5": F.avg("close").over(series().rowsBetween(-5, -1)),
                  "naive": F.lag("close").over(series())}
        wide = self.bars.select("symbol", "date", F.col("close").alias("y_true"),
                                F.row_number().over(series()).alias("rn"),
                                *[c.alias(m) for m, c in models.items()]).where("rn > 10")
        return wide.unpivot(["symbol", "date", "y_true"], list(models), "model", "y_pred")

    @cached_property
    def earnings(self) -> DataFrame:
        q = self.bars.groupBy("symbol", F.trunc("date", "quarter").alias("date")).agg(F.avg("close").alias("eps_actual"))
        return q.withColumn("eps_estimate", F.lag("eps_actual").over(series()))

    @cached_property
    def articles(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", F.md5(F.col("doc_id").cast("string")).alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("link"),
            F.col("text").alias("content"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("published"),
            "source", "lang")

    @cached_property
    def questions(self) -> DataFrame:
        """User turns as questions: the turn itself, or with a sample question before or behind it."""
        n = F.col("conv_id") + F.col("turn")
        sample = F.element_at(F.array(*[F.lit(x) for x in SAMPLE_QUESTIONS]), (n % 5 + 1).cast("int"))
        query = F.when(n % 3 == 0, F.concat("text", F.lit(" "), sample)).when(n % 3 == 1, F.col("text")).otherwise(F.concat(sample, F.lit(" "), "text"))
        turns = self.raw("conversations").where("role = 'user'")
        return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), query.alias("query"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @cached_property
    def centroids(self) -> DataFrame:
        """Mean vector per label, as a query table; the number of labels is small and fixed."""
        cells = self.vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
        return means.groupBy("label").agg(vector.alias("embedding")).select(F.col("label").alias("query_id"), "embedding")

    @cached_property
    def vector_articles(self) -> DataFrame:
        """Articles that have a vector."""
        return self.vectors.join(self.articles.withColumnRenamed("id", "article_id"), F.col("id") == F.col("doc_id")).drop("doc_id")
