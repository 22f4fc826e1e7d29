"""Document quality by a text classifier and the sites' records, shrunk level by level."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import sample
from barloom.llm.words import SPACE, bounded, mix, words
from barloom.sources.readers import materialize

#: Bits of a hashed word, labelled documents to learn from (about; twice as many at most) and bytes that each may
#: have (this bounds what the driver takes), documents that a word needs among them and standard errors by which it must tell them apart, weight of an unlabelled document in its site's record.
FEATURES, LABELS, LABEL_BYTES, LEAST, CLEAR, SOFT = 18, 8192, 1 << 15, 5, 3.5, 0.1
SHAPES = 10
#: Bytes of the beginnings of words that count as words of their own.
HEADS = (5, 7)
#: Bytes between words: white space and ASCII punctuation.
WHITE = SPACE.copy()
WHITE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SYMBOL, PIPE, MARK, DIGIT, UPPER = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&<>{}[]=+_^~\\", b"|", b"!?", b"0123456789", bytes(range(65, 91))))


class Evidence(NamedTuple):
    """Distinct hashed words and word beginnings per document, and some numbers about its form."""

    words: np.ndarray
    bounds: np.ndarray
    shapes: np.ndarray


def evidence(column: pa.Array) -> Evidence:
    w = words(column, lower=True, white=WHITE)
    plain = words(column)
    n_docs = len(w.bounds) - 1
    hashes = [w.hashes, *(mix(words(column, lower=True, white=WHITE, head=k).hashes + np.uint64(k)) for k in HEADS)]
    owner = np.repeat(np.arange(n_docs), np.diff(w.bounds)) << FEATURES
    pair = np.unique(np.concatenate([owner | (h >> np.uint64(64 - FEATURES)).astype(np.int64) for h in hashes]))
    bounds = np.searchsorted(pair, np.arange(n_docs + 1) << FEATURES)
    text = column.fill_null("") if column.null_count else column
    size = np.array([len(x.as_buffer()) if x.as_buffer() is not None else 0 for x in text], np.int64)
    ends = np.cumsum(size)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[w.data])])
        return (total[ends] - total[ends - size]) / np.maximum(size, 1)

    n = np.diff(plain.bounds)
    lines = share(np.arange(256) == 10)
    same = np.zeros(len(plain.hashes) + 1, np.int64)
    if len(plain.hashes):
        same[2:] = np.cumsum(plain.hashes[1:] == plain.hashes[:-1])
    again = (same[plain.bounds[1:]] - same[np.minimum(plain.bounds[:-1] + 1, plain.bounds[1:])]) / np.maximum(n, 1)
    fresh = np.diff(bounds) / np.maximum(len(hashes) * np.diff(w.bounds), 1)
    per_word = size / np.maximum(n, 1)
    full = lambda x: np.minimum(x, 1)  # noqa: E731  forms count by their share, up to a point
    shapes = np.stack([np.log1p(n) / 10, full(share(SYMBOL) * per_word), full(4 * share(PIPE) * per_word), full(5 * share(DIGIT)), full(3 * share(UPPER)), full(per_word / 20),
                       full(20 * lines), full(3 * again), fresh, full(share(MARK) * per_word)], 1)
    return Evidence(pair & ((1 << FEATURES) - 1), bounds, shapes.astype(np.float32))


class Classifier(NamedTuple):
    words: np.ndarray  # float32, one weight per hashed word
    shapes: np.ndarray
    bias: float

    def log_odds(self, e: Evidence) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.words[e.words], dtype=np.float64)])
        return total[e.bounds[1:]] - total[e.bounds[:-1]] + e.shapes @ self.shapes + self.bias


def train(e: Evidence, good: np.ndarray, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Classifier:
    """Logistic regression by adaptive gradient steps.  A word has a weight only if LEAST documents hold it and its share
    among the bad ones differs from that among the good ones by CLEAR standard errors, so that the thousands of words
    that say nothing don't add up in long texts."""
    per_word = np.repeat(good, np.diff(e.bounds))
    held, held_good = np.bincount(e.words, minlength=1 << FEATURES), np.bincount(e.words, weights=per_word, minlength=1 << FEATURES)
    n, n_good = len(good), max(1.0, good.sum())
    n_bad, rate_all = max(1.0, n - good.sum()), np.clip(held / n, 1e-9, 1 - 1e-9)
    z = ((held - held_good) / n_bad - held_good / n_good) / np.sqrt(rate_all * (1 - rate_all) * (1 / n_bad + 1 / n_good))
    often = (held >= LEAST) & (np.abs(z) >= CLEAR)
    weight, power = np.zeros(1 << FEATURES), np.full(1 << FEATURES, 1e-8)
    shape, shape_power = np.zeros(e.shapes.shape[1] + 1), np.full(e.shapes.shape[1] + 1, 1e-8)
    x = np.concatenate([e.shapes, np.ones((len(good), 1))], 1)
    order = np.random.default_rng(7).permutation(len(good))
    for _ in range(epochs):
        for a in range(0, len(order), 128):
            rows = order[a:a + 128]
            n = e.bounds[rows + 1] - e.bounds[rows]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(e.bounds[rows] - ends + n, n)
            keys, owner = e.words[at], np.repeat(np.arange(len(rows)), n)
            keep = often[keys]
            keys, owner = keys[keep], owner[keep]
            z = np.bincount(owner, weights=weight[keys], minlength=len(rows)) + x[rows] @ shape
            error = good[rows] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            used, which = np.unique(keys, return_inverse=True)
            gradient = np.bincount(which, weights=error[owner], minlength=len(used)) / len(rows) - decay * weight[used]
            power[used] += gradient ** 2
            weight[used] += rate * gradient / np.sqrt(power[used])
            g = x[rows].T @ error / len(rows)
            shape_power += g ** 2
            shape += 3 * rate * g / np.sqrt(shape_power)
    return Classifier(weight.astype(np.float32), shape[:-1], float(shape[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From about LABELS labelled documents, chosen by hash, those of at most LABEL_BYTES bytes."""
    chosen = sample(labels, LABELS, "doc_id")
    rows = docs.where(F.octet_length("text") <= LABEL_BYTES).join(F.broadcast(chosen), "doc_id").select("text", "good")  # 2 * LABELS rows of two numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 22):
            e = evidence(batch.column(0))
            packed = [e.words[a:b].astype(np.uint32).tobytes() for a, b in zip(e.bounds, e.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in e.shapes], pa.binary())], ["good", "words", "shapes"])

    found = sorted(rows.mapInArrow(run, "good boolean, words binary, shapes binary").collect(), key=lambda r: (bytes(r.words), bytes(r.shapes)))
    if not found:
        return Classifier(np.zeros(1 << FEATURES, np.float32), np.zeros(SHAPES), 0.0)
    each = [np.frombuffer(r.words, np.uint32).astype(np.int64) for r in found]
    e = Evidence(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.stack([np.frombuffer(r.shapes, np.float32) for r in found]))
    return train(e, np.array([r.good for r in found], float))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(record: DataFrame, level: str) -> DataFrame:
    """How many documents the level above is worth, from the spread of the groups around it (method of moments).

    ``record``: n, good and prior (the rate of the level above) per group.  One row: the strength, between 1 and 1e6; a
    spread no larger than chance gives the most.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2))
    chance = F.sum(F.col("prior") * (1 - F.col("prior"))) * (1 - 1 / F.count("*"))
    room = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    between = F.greatest((spread - chance) / F.greatest(room, F.lit(1e-9)), F.lit(1e-9))
    binomial = F.sum(F.col("prior") * (1 - F.col("prior")) * F.col("n")) / F.sum("n")
    return record.where("n > 0").agg(F.greatest(F.least(F.coalesce(binomial / between - 1, F.lit(1e6)), F.lit(1e6)), F.lit(1.0)).alias(level))


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds site_rate: the rate of good documents of the row's path, shrunk toward its host's, and that toward the global one.

    ``scored``: host, path, weight and good_weight per document.  Both levels are grouped sums that combine before the
    shuffle, so a host with a third of the documents is one row per task; hosts and paths with few documents take
    their parent's rate.
    """
    sums = [F.sum("weight").alias("n"), F.sum("good_weight").alias("good")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.greatest(F.least((F.sum("good") + 0.5) / (F.sum("n") + 1), F.lit(0.999)), F.lit(0.001)).alias("p")).first()
    overall = F.lit(float(total.p) if total and total.p is not None else 0.5)
    hosts = hosts.withColumn("prior", overall)
    m_host = strength(hosts, "m").first().m
    hosts = hosts.select("host", ((F.col("good") + m_host * overall) / (F.col("n") + m_host)).alias("prior"))
    paths = paths.join(hosts, "host")
    m_path = strength(paths, "m").first().m
    rates = paths.select("host", "path", ((F.col("good") + m_path * F.col("prior")) / (F.col("n") + m_path)).alias("site_rate"))
    return scored.join(rates, ["host", "path"]).withColumn("global_rate", overall)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, host, path, evidence (log odds of the text), site_rate, posterior and kept, per row of docs.

    A document is good if its label says quality 1 and not toxic; repeated labels of one document must agree on that, and
    rows with a null doc_id or quality do not count (a null toxic is not toxic).  The classifier is fitted on a bounded
    sample of the labels (see ``fit``); a site's record counts every labelled document fully and every other one as SOFT
    times the classifier's probability.  The posterior's log odds are the text's plus the difference of the site's from
    the global ones.  Null hosts and paths are groups of their own; null and empty texts are judged by their form.
    Without labels all evidence is zero and every document is kept.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).alias("good"))
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1 << 22):
            odds = np.clip(model.value.log_odds(evidence(batch.column(3))), -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds)], ["doc_id", "host", "path", "evidence"])

    scored = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, host string, path string, evidence double")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    scored = scored.join(known, "doc_id", "left").withColumn("weight", F.when(F.col("good").isNull(), SOFT).otherwise(1.0)).withColumn(
        "good_weight", F.col("weight") * F.coalesce(F.col("good").cast("double"), p)).drop("good")
    found = posteriors(materialize(scored, "evidence"))
    odds = F.col("evidence") + logit(F.greatest(F.least("site_rate", F.lit(0.999)), F.lit(0.001))) - logit(F.col("global_rate"))
    return found.withColumn("posterior", 1 / (1 + F.exp(-odds))).select(
        "doc_id", "host", "path", "evidence", "site_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))
