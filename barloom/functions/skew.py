"""Joins that stay even when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000


def join_unique(big: DataFrame, small: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and the key's row count of ``big`` in ``rows``.

    Keys that own more than 1/10,000 of the rows, of which there are fewer than 10,000 whatever the size of the
    data, are broadcast and joined where the rows are; all other keys are small and go through the shuffle.
    """
    total = small.agg(F.sum(rows)).scalar()
    small = small.withColumn("_hot", F.col(rows) * HOT_SHARE > total).drop(rows)
    payload = [c for c in small.columns if c not in (key, "_hot")]
    hot = F.broadcast(small.where("_hot"))
    marked = big.join(hot, key, "left")
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").drop("_hot", *payload)
    return done.unionByName(rest.join(small.where("NOT _hot").drop("_hot"), key))
