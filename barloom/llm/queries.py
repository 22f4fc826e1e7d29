"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to."""
    import public_tokenizers

    from barloom.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(table(spark, sf_dir, "documents"), path)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    from barloom.llm import warc
    from barloom.sources.readers import shared_folder

    path = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to, true AS complete
FROM r"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the risk-controlled rules for every document."""
    from barloom.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rejected_by")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that spread over many sites."""
    from pyspark.sql import functions as F

    from barloom.llm import line_dedup

    kept = line_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of thirteen words that an earlier document holds."""
    from pyspark.sql import functions as F

    from barloom.llm import substring_dedup

    return substring_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the item and the place."""
    from barloom.llm import decontamination

    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles agree by nine tenths."""
    from barloom.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under unigrams and under the mixed-context model."""
    from barloom.llm import lm_scoring

    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document from its text and its site."""
    from barloom.llm import quality_classifier

    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as mails that quote each other, linked by their quotes and freed of them."""
    from pyspark.sql import functions as F

    from barloom.llm import chat

    mails = chat.quoting(table(spark, sf_dir, "conversations"))
    linked = chat.conversations(mails)
    return linked.select("conv_id", "turn", F.col("id").alias("message_id"), "parent_id", "root_id", "depth", "n_quoted",
                         F.sha2("own", 256).alias("own_sha256"), F.length(chat.template(F.col("role"), F.col("own"))).alias("n_formatted"))


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of them."""
    from barloom.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle examples of every document, and the texts rebuilt from them."""
    from barloom.llm import fill_in_middle

    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, each part looked up in a tree over its codebook."""
    from barloom.llm import vector_codes

    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def _sql() -> None:
    from barloom.llm import fill_in_middle, language_id, line_dedup, quality_rules, vector_codes

    SQL["op11_language_id"] = language_id.sql()
    SQL["op12_fill_in_middle"] = fill_in_middle.sql()
    SQL["op13_vector_codes"] = vector_codes.sql()
    SQL["op2_quality_rules"] = quality_rules.sql()
    SQL["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM p) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM late, (SELECT unnest(range(0, 13)) AS d)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) x
      ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""
    SQL["op10_line_dedup"] = line_dedup.sql()
    SQL["op9_chat"] = r"""
WITH c AS (SELECT *, conv_id * 1048576 + turn AS id, min(turn) OVER (PARTITION BY conv_id) AS first_turn,
                  regexp_replace(text, '^(?:[ \t]*\n)+|\s+$', '', 'g') AS own, len(string_split(text, chr(10))) AS n_lines FROM conversations)
SELECT conv_id, turn, id AS message_id, CASE WHEN turn > first_turn THEN id - 1 END AS parent_id, conv_id * 1048576 + first_turn AS root_id,
       CAST(turn - first_turn AS INTEGER) AS depth,
       CAST(coalesce(sum(n_lines) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_quoted,
       sha256(own) AS own_sha256, CAST(length(role) + length(own) + 14 AS INTEGER) AS n_formatted
FROM c"""


_sql()
