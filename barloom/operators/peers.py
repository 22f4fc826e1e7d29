"""Comparison of one target series with all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import stats as st
from barloom.functions.frames import series


def peer_compare(returns: DataFrame, target, n: int = 5) -> DataFrame:
    """Peers of ``target`` by |correlation|, rows matched by position from the start; shorter series are left out.

    The target series is calendar-bounded and is broadcast by position.
    """
    df = returns.withColumn("i", F.row_number().over(series()))
    t = df.where(F.col("symbol") == target).select("i", F.col("ret").alias("t"))
    length = t.agg(F.count("*")).scalar()
    both = df.where(F.col("symbol") != target).join(F.broadcast(t), "i", "left")
    out = both.groupBy("symbol").agg(
        F.corr("ret", "t").alias("correlation"), F.count("t").alias("n"), F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"),
        st.ratio(F.covar_samp("ret", "t"), F.var_samp("t")).alias("beta")).withColumn("_len", length)
    top = out.where(F.col("n") == F.col("_len")).drop("_len").orderBy(F.desc(F.abs("correlation")), "symbol").limit(n)
    top = st.pearson_p(top)
    # fixed values: the grades and their limits
    return top.withColumn("significance", F.when(F.col("p_value") < 0.05, "High").when(F.col("p_value") < 0.1, "Medium").otherwise("Low"))


def peer_sheet(returns: DataFrame, target, n: int = 5) -> DataFrame:
    """The target's own row (mean return and volatility) above those of ``peer_compare``; ``role`` tells them apart."""
    own = returns.where(F.col("symbol") == target).groupBy("symbol").agg(F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"))
    return own.withColumn("role", F.lit("target")).unionByName(peer_compare(returns, target, n).withColumn("role", F.lit("peer")), allowMissingColumns=True)


def top_peers(returns: DataFrame, target, sizes: DataFrame | None = None, n: int = 5, min_rows: int = 20) -> DataFrame:
    """Peers by 0.5 correlation + 0.3 beta + 0.2 size similarity on common dates; ``sizes`` holds (symbol, size)."""
    t = returns.where(F.col("symbol") == target).select("date", F.col("ret").alias("t"))
    both = returns.where(F.col("symbol") != target).join(F.broadcast(t), "date")
    out = both.groupBy("symbol").agg(
        F.corr("ret", "t").alias("correlation"), F.count("*").alias("n"), st.ratio(F.covar_samp("ret", "t"), F.var_samp("t")).alias("beta"),
        F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility")).where(F.col("n") >= min_rows)
    if sizes is None:
        out = out.withColumn("relative_size", F.lit(1.0))
    else:
        own = sizes.where(F.col("symbol") == target).agg(F.max("size")).scalar()
        out = out.join(sizes, "symbol", "left").withColumn("_own", own).withColumn(
            "relative_size", F.when(F.col("_own") > 0, F.col("size") / F.col("_own")).otherwise(1.0)).drop("size", "_own")
    score = (0.5 * (F.abs("correlation") + 1) / 2 + 0.3 * (1 - F.least(F.abs(F.col("beta") - 1), F.lit(1.0)))
             + 0.2 * (1 - F.least(F.abs(F.log10("relative_size")), F.lit(1.0))))
    return st.pearson_p(out.withColumn("similarity_score", score).orderBy(F.desc("similarity_score"), "symbol").limit(n))
