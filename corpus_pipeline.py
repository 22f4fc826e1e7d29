"""A corpus pipeline: quality rules, line dedup, near-duplicate documents, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Nulls, empty and very long texts,
repeated rows and further columns are treated as the operators of ``barloom.llm`` say; an empty table gives an empty one.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, decontamination, jaccard_join, line_dedup, quality_rules
from barloom.llm.queries import table
from barloom.sources.readers import materialize

#: Path of the rank file; a name alone is looked up among the installed vocabularies.
RANKS = os.environ.get("PIPELINE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found on many sites out of all documents but the first that holds them; n_chars follows the text."""
    kept = line_dedup.remove(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.first_of_each(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids (little-endian 32-bit integers) and their number."""
    return byte_bpe.encode(docs, RANKS).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("jaccard_join", drop_copies), ("decontamination", drop_leaks), ("byte_bpe", tokenize)]

#: The near-duplicate and token stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
