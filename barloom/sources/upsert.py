"""Keyed upserts, updates and deletes as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """Incoming fields replace those of the stored row with the same key; keys that are not stored are added.

    A field that is null or absent in the incoming row keeps its stored value.  Where a key arrives more than once the
    last value of each field counts, by ``updated_at`` and then by the row's values.  Only the incoming rows are
    aggregated, before and after the shuffle; the stored rows, one per key, are joined as they are.
    """
    if now is not None:
        incoming = incoming.withColumn("updated_at", now)
    given = [c for c in incoming.columns if c not in keys]
    order = F.struct(*(["updated_at"] if "updated_at" in given else []), *[c for c in given if c != "updated_at"], F.lit(0))
    last = incoming.groupBy(*keys).agg(F.lit(True).alias("_in"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in given])
    last = last.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [stored[k].eqNullSafe(last[f"_{k}"]) for k in keys]
    joined = stored.join(last, same, "full")
    rest = [c for c in stored.columns if c not in keys]
    columns = [F.when(F.col("_in"), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    columns += [F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in rest]
    return joined.select(*columns, *[F.col(f"_{c}").alias(c) for c in given if c not in rest])


def event_key(id_col: str, time_col: str) -> Column:
    """The event id, or the time where there is none."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t:"), F.col(time_col).cast("string")))


def indicators_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(symbol, indicator, date, value) form of indicator columns."""
    return df.unpivot(["symbol", "date"], cols, "indicator", "value").where("value IS NOT NULL")


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in df.columns else F.when(hit, v) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))
