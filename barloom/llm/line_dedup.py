"""Lines that spread over many sites, found by HyperLogLog sketches.  Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.quality_rules import let
from barloom.sources.readers import materialize

#: Distinct sites from which on a line is boilerplate, words that a line needs to be judged, size of a sketch (log2).
SITES, WORDS, SKETCH = 10, 3, 12
LINE_WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def spread(lines: DataFrame, sites: int = SITES, sketch: int = SKETCH) -> DataFrame:
    """Keys (h1, h2) of lines on ``sites`` distinct sites or more, with the least document that holds each (first_doc).

    ``lines``: h1, h2, site, doc_id.  A sketch per key merges by aggregation, so every task sends one of bounded size per
    key, however many documents share a line.  Estimates that three standard errors cannot tell from the threshold are
    replaced by exact distinct counts over the lines of those keys alone; pairs of key and site combine first.
    """
    margin = 3 * 1.04 / math.sqrt(1 << sketch)
    low, high = math.floor(sites * (1 - margin)), math.ceil(sites * (1 + margin))
    estimated = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", sketch)).alias("sites"), F.min("doc_id").alias("first_doc")).where(F.col("sites") >= low)
    estimated = materialize(estimated, "spread")
    near = estimated.where(F.col("sites") <= high).select("h1", "h2")
    exact = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    checked = estimated.join(exact.where(F.col("exact") >= sites), ["h1", "h2"], "left")
    found = checked.where((F.col("sites") > high) | F.col("exact").isNotNull()).select("h1", "h2", "first_doc")
    return materialize(found, "boilerplate")


def remove(docs: DataFrame, sites: int = SITES, words: int = WORDS, text: str = "text", site: str = "source") -> DataFrame:
    """Takes lines found on ``sites`` distinct sites or more out of every document but the one with the least doc_id.

    Lines are parts between \\n, compared without blanks at their ends; those with fewer than ``words`` words stay.  All
    columns are kept and ``text`` is replaced; n_lines (lines with a word) and n_removed are added, replacing columns of
    these names.  A null text stays null and an untouched text stays as it is.  A null site is a site of its own.  A line
    that only documents with a null doc_id hold is removed from all of them.  Repeated rows are treated alike.
    """
    key = F.xxhash64(F.col("doc_id"), F.col(text), F.lit(7))
    row = docs.withColumn("_row", key)
    parts = docs.where(F.col(text).isNotNull()).select(
        key.alias("_row"), "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    many = "{%d}" % (words - 1) if words > 1 else "{0}"
    parts = parts.where(F.regexp_like("line", F.lit(f"({LINE_WORD}{BLANK}){many}{LINE_WORD}"))).withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c")))
    # 128 bits per line, written once: three passes follow, none of which needs the texts
    parts = materialize(parts.select("_row", "doc_id", F.xxhash64("site").alias("site"), "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    found = spread(parts, sites)
    gone = parts.join(found, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.select("_row", "at").distinct().groupBy("_row").agg(F.collect_list("at").alias("_gone"))  # lines of one document
    lines = F.split(text, "\n")
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(LINE_WORD)))))
    out = row.join(gone, "_row", "left").withColumns({
        "n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)})
    return out.drop("_row", "_gone")


def sql(sites: int = SITES, words: int = WORDS) -> str:
    """The same for DuckDB, over documents with source as the site."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, site, i, lines[i] AS raw, trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
b AS (SELECT line, min(doc_id) AS first_doc FROM l
      WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {words} GROUP BY line HAVING count(DISTINCT site) >= {sites}),
k AS (SELECT doc_id, i, raw, b.line IS NOT NULL AND doc_id <> first_doc AS gone, regexp_matches(raw, '[^\\x20\\x09-\\x0D]') AS worded FROM l LEFT JOIN b USING (line))
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id"""
