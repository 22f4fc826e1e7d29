"""Stored tables with commits: upserts that rewrite the touched partitions only and become visible all at once.

A table is a folder with ``data`` and ``commits``.  A commit is a small JSON file that names, for every partition, the
folder with its rows, and the batches applied so far.  Readers take the commit with the highest number.  A writer puts
merged partitions into new folders, which nobody reads yet, and then publishes the next commit by a rename that fails if
the number is taken.  A job that dies before that leaves the table as it was; one that loses a race starts over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.upsert import upsert

#: Times a writer starts over when other writers publish first.
ATTEMPTS = 5


class Conflict(Exception):
    """Another writer has published this commit number."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published commits."""
    files, folder = _files(spark, path), _path(spark, f"{path}/commits")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commit(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A published commit, the newest by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no commit {'' if version is None else version} of {path}")
    version = known[-1] if version is None else version
    stream = _files(spark, path).open(_path(spark, f"{path}/commits/{version}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"version": version}


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes a commit visible in one step; raises Conflict if its number is taken."""
    jvm = spark._jvm
    files = _files(spark, path)
    draft, target = _path(spark, f"{path}/commits/.{uuid.uuid4().hex}"), _path(spark, f"{path}/commits/{version}.json")
    out = files.create(draft, False)
    try:
        out.write(json.dumps(content).encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"commit {version} of {path}") from e
        raise


def _write(df: DataFrame, path: str, partition: Column) -> dict[str, str]:
    """Rows in a new folder per partition; the folders by partition name.  A null partition is named ``null``."""
    folder = f"data/{uuid.uuid4().hex}"
    named = df.withColumn("_partition", F.coalesce(partition.cast("string"), F.lit("null")))
    named.write.partitionBy("_partition").parquet(f"{path}/{folder}")
    files = _files(df.sparkSession, path)
    out = {}
    for status in files.listStatus(_path(df.sparkSession, f"{path}/{folder}")):
        name = status.getPath().getName()
        if name.startswith("_partition="):
            value = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[len("_partition="):])
            out[value] = f"{folder}/{name}"
    return out


def create(df: DataFrame, path: str, partition: Column) -> int:
    """A new table with the rows of ``df``, one per key; ``partition`` is an expression over key columns."""
    publish(df.sparkSession, path, 0, {"schema": df.schema.jsonValue(), "partitions": _write(df, path, partition), "batches": []})
    return 0


def read(spark: SparkSession, path: str, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
    """The table as of a commit (the newest by default), or some of its partitions; other folders are not opened."""
    at = commit(spark, path, version)
    schema = T.StructType.fromJson(at["schema"])
    folders = [f"{path}/{folder}" for name, folder in sorted(at["partitions"].items()) if partitions is None or name in partitions]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: Column, batch: str, now: Column | None = None) -> int:
    """Merges a batch into the table as ``upsert`` does and returns the number of the commit that holds it.

    Only partitions with incoming rows are read and rewritten; the others stay where they are.  ``partition`` is the
    expression the table was created with.  A batch that is already applied changes nothing, so a caller may repeat one
    whose outcome it does not know.  Columns that only the batch has are added, and are null in the rows not rewritten.
    """
    for _ in range(ATTEMPTS):
        at = commit(spark, path)
        if batch in at["batches"]:
            return at["version"]
        names = [r[0] for r in incoming.select(F.coalesce(partition.cast("string"), F.lit("null"))).distinct().collect()]  # partitions, not rows
        merged = upsert(read(spark, path, at["version"], names), incoming, keys, now)
        schema = T.StructType.fromJson(at["schema"])
        schema = T.StructType([*schema.fields, *[f for f in merged.schema.fields if f.name not in schema.names]])
        content = {"schema": schema.jsonValue(), "partitions": at["partitions"] | _write(merged, path, partition), "batches": [*at["batches"], batch]}
        try:
            publish(spark, path, at["version"] + 1, content)
            return at["version"] + 1
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} attempts at {path}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes what none of the last ``keep`` commits names: older commits and folders of jobs that died.  Not to be run
    beside a writer.  Returns the number of folders deleted."""
    known = versions(spark, path)
    used = {folder for v in known[-keep:] for folder in commit(spark, path, v)["partitions"].values()}
    files, gone = _files(spark, path), 0
    for v in known[:-keep]:
        files.delete(_path(spark, f"{path}/commits/{v}.json"), False)
    for run in files.listStatus(_path(spark, f"{path}/data")):
        left = 0
        for status in files.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{status.getPath().getName()}"
            if status.isDirectory() and name not in used:
                files.delete(status.getPath(), True)
                gone += 1
            else:
                left += status.isDirectory()
        if not left:
            files.delete(run.getPath(), True)
    return gone
