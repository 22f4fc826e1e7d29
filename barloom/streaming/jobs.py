"""Streaming bars, rolling statistics, sessions, alerts and news collection.

Every job is a plain streaming DataFrame; ``run`` drains the available input through ``foreachBatch``.  A batch
writes its own folder and overwrites it when it is replayed, so a restart after a lost executor neither loses nor
doubles rows.  Updates of a key are kept as versions and read back as the newest one.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.readers import shared_folder

EPOCH = datetime.date(1970, 1, 1).toordinal()


def read_files(spark: SparkSession, folder: str, name: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files that match ``name``, or that lie in folders that do; a plain path could only be a folder."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{folder}/{{{name}}}")


def read_ticks(spark: SparkSession, folder: str, name: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """Ticks (symbol, ts, event_id, value, event_type) from Parquet files, event time as TIMESTAMP."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return read_files(spark, folder, name, schema, per_batch).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("symbol"), "event_type", "value")


def stream_bars(ticks: DataFrame, interval: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV per symbol and interval; ticks later than the watermark are dropped."""
    key = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", interval).alias("w")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"),
        F.count("*").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def stream_rolling(ticks: DataFrame, span: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    """Mean and std per symbol over sliding windows."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", span, step).alias("w")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), "mean", "std", "n")


def stream_sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Closed activity sessions per symbol."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")


class Rule(NamedTuple):
    """An alert on a numeric column of the bars; without a symbol it holds for all, and one that is not active never fires."""

    id: str
    kind: str  # above, below or crossing
    level: float
    field: str = "close"
    symbol: object = None
    is_active: bool = True


def stream_alerts(bars: DataFrame, rules: list[Rule | tuple]) -> DataFrame:
    """Alerts of rules on new bars: symbol, date, rule, field, value, previous, last_triggered, late.

    Rules look at any numeric column: closes, volumes, indicators.  ``previous`` is the field's value at the bar before and
    ``last_triggered`` the date at which the rule last fired for the symbol.  Both are state per symbol, as is the newest
    date, so they carry over micro-batches and restarts.  A bar that is not newer than an earlier one of its symbol, or
    has no date, fires nothing and changes no state; it comes out as a row with ``late`` and without a rule.  A null value
    never fires, and there is no crossing from or to it.
    """
    active = [r for r in (Rule(*r) for r in rules) if r.is_active]
    if any(r.kind not in ("above", "below", "crossing") for r in active) or len({r.id for r in active}) < len(active):
        raise ValueError("rules are above, below or crossing and have an id of their own")
    fields = sorted({r.field for r in active})
    kind = dict(bars.dtypes)["symbol"]
    # tasks see numbers alone: days since 1970, values, and the rule by its place
    columns = ["symbol", "day", "rule", "value", "previous", "last", "late"]
    numbers = bars.select("symbol", F.unix_date("date").cast("double").alias("day"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(fields)])

    def check(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *rest = state.get if state.exists else (None,) * (1 + len(fields) + len(active))
        previous, fired = rest[:len(fields)], rest[len(fields):]
        parts = [[f[c].to_numpy(float, na_value=np.nan) for c in numbers_of] for f in frames]
        rows = np.array([np.concatenate(p) for p in zip(*parts)])
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        newest = -np.inf if seen is None else _day(seen)
        fresh = rows[0] > np.maximum(newest, np.append(newest, rows[0, :-1]))
        late = rows[0, ~fresh]
        none = np.full(len(late), np.nan)
        out, (day, *values) = [(late, none, none, none, none, np.ones(len(late), bool))], rows[:, fresh]
        for i, r in enumerate(active):
            if len(day) and r.symbol in (None, key[0]):
                at = fields.index(r.field)
                value = values[at]
                last = np.append(np.nan if previous[at] is None else previous[at], value[:-1])
                hits = {"above": value > r.level, "below": value < r.level, "crossing": (last - r.level) * (value - r.level) < 0}[r.kind]
                days = day[hits]
                if len(days):
                    earlier = np.append(np.nan if fired[i] is None else _day(fired[i]), days[:-1])
                    out.append((days, np.full(len(days), float(i)), value[hits], last[hits], earlier, np.zeros(len(days), bool)))
                    fired[i] = _date(days[-1])
        if len(day):
            state.update((_date(day[-1]), *[float(v[-1]) for v in values], *fired))
        made = [np.concatenate(c) for c in zip(*out)]
        if len(made[0]):
            yield pd.DataFrame(dict(zip(columns, [[key[0]] * len(made[0]), *made])))

    numbers_of = numbers.columns[1:]
    stored = ", ".join(["seen string", *[f"p{i} double" for i in range(len(fields))], *[f"t{i} string" for i in range(len(active))]])
    found = numbers.groupBy("symbol").applyInPandasWithState(
        check, f"symbol {kind}, day double, rule double, value double, previous double, last double, late boolean", stored, "append", GroupStateTimeout.NoTimeout)
    named = lambda names: F.get(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("rule").cast("int"))
    date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return found.select("symbol", date("day").alias("date"), named([r.id for r in active]).alias("rule"), named([r.field for r in active]).alias("field"),
                        "value", "previous", date("last").alias("last_triggered"), "late")


def _day(text: str) -> float:
    return float(datetime.date.fromisoformat(text).toordinal() - EPOCH)


def _date(day: float) -> str:
    return str(datetime.date.fromordinal(int(day) + EPOCH))


def stream_news(items: DataFrame, late: str = "120 days") -> DataFrame:
    """News items whose id was not seen within the watermark."""
    return items.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["id"])


def run(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """Drains the available input and returns what was written; with keys, the newest version of each.  ``base`` is the
    folder of an earlier run to go on from: its checkpoint and all that it wrote."""
    spark = stream.sparkSession
    base = base or shared_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kinds, out = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]), spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    ran = out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out)  # without any input there is no batch
    written = spark.read.schema(kinds).parquet(f"{base}/out") if ran else spark.createDataFrame([], kinds)
    if not keys:
        return written.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
