"""File scans, range scans and cache-aside reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS_SCHEMA = "symbol bigint, date date, open double, high double, low double, close double, volume bigint"


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names in spark.checkpoint.dir.

    Where that is unset, a session on one machine (a ``local`` master) gets a temporary folder; on a cluster it is an
    error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="barloom-")
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes the table once to the shared folder and reads it back: for inputs that a job passes over several
    times.  Lineage ends at files that survive the loss of an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def bucketed(df: DataFrame, by: str, count: int, name: str = "stage") -> DataFrame:
    """Like ``materialize``, with the rows in ``count`` buckets of the column ``by``, which has no nulls: tables with the same
    buckets are joined by it without a shuffle."""
    spark = df.sparkSession
    path, table = shared_folder(spark, name), f"barloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(count, by).saveAsTable(table)
    stored = spark.table(table)
    stored.stored_at, stored.stored_as = path, table
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` or ``bucketed`` has written, once nothing reads them any more."""
    for table in tables:
        if hasattr(table, "stored_as"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.stored_as}")
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def scan_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, JSON or Parquet by extension, with an explicit schema where given."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind == "json":
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported data format: {path}")


def write_files(df: DataFrame, path: str, compression: str = "gzip") -> str:
    """CSV, JSON or Parquet by extension; text is packed, as it takes several times the room of the values."""
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path, compression=compression)
    elif kind == "json":
        writer.json(path, compression=compression)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported data format: {path}")
    return path


def scan_bars_range(bars: DataFrame, symbol, start=None, end=None) -> DataFrame:
    """Bars of one symbol inside an inclusive date range, by date."""
    df = bars.where(F.col("symbol") == symbol)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.orderBy("date")


def scan_bars_batch(bars: DataFrame, wanted: DataFrame, start=None, end=None) -> DataFrame:
    """Rows per requested symbol with a status; a symbol without bars yields one error row, not a failure."""
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    df = wanted.select("symbol").distinct().join(bars, "symbol", "left")
    return df.withColumn("status", F.when(F.col("date").isNull(), "error: no data").otherwise("ok"))


def read_through(stored: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows where present, otherwise source rows."""
    return stored.unionByName(source.join(stored.select(*keys), keys, "left_anti"))


def symbol_search(securities: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Symbols whose name contains the keyword, with an edit-distance score, best first."""
    name, key = F.lower("name"), F.lit(keyword.lower())
    score = 1 - F.levenshtein(name, key) / F.greatest(F.length(name), F.length(key))
    return securities.where(F.contains(name, key)).select("symbol", "name", score.alias("match_score")).orderBy(F.desc("match_score"), "symbol").limit(limit)


def split_dataset(df: DataFrame, chunks: int, first: str, rest: list[str]) -> DataFrame:
    """Contiguous near-equal chunks in the order (first, *rest), the remainder in the last one."""
    from barloom.functions.order import with_row_index

    n = df.agg(F.count("*")).scalar()
    df = with_row_index(df, first, rest).withColumn("_size", F.greatest(F.floor(n / chunks), F.lit(1)))
    return df.withColumn("chunk", F.least(F.floor(F.col("row_index") / F.col("_size")), F.lit(chunks - 1)).cast("int")).drop("_size")


def dataset_profile(df: DataFrame, numeric: list[str], date: str = "date") -> DataFrame:
    """Rows, columns, date range, missing flag and per-column statistics in one pass."""
    missing = sum(F.count_if(F.col(c).isNull()) for c in df.columns)
    stats = [f(c).alias(f"{c}_{n}") for c in numeric for n, f in {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items()]
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count"), F.min(date).alias("start_date"),
                  F.max(date).alias("end_date"), (missing > 0).alias("has_missing"), *stats)


def dataset_version_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Shape change, columns added and removed, and rows added, removed and changed by key."""
    common = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, F.xxhash64(*common).alias("_a"), F.lit(1).alias("_ia"))
    b = new.select(*keys, F.xxhash64(*common).alias("_b"), F.lit(1).alias("_ib"))
    j = a.join(b, keys, "full")
    return j.agg(
        F.count("_ia").alias("rows_old"), F.count("_ib").alias("rows_new"), F.count_if(F.col("_ia").isNull()).alias("rows_added"),
        F.count_if(F.col("_ib").isNull()).alias("rows_removed"), F.count_if(F.col("_a") != F.col("_b")).alias("rows_changed"),
        F.lit(",".join(sorted(set(new.columns) - set(old.columns)))).alias("columns_added"),
        F.lit(",".join(sorted(set(old.columns) - set(new.columns)))).alias("columns_removed"))
