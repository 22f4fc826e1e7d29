"""Languages of whole texts by rank order: the most frequent n-grams of a text against those of each language.

Words are runs of letters and marks, lower-cased letter by letter; an n-gram is up to three neighbouring characters of a
word with one boundary on either side.  A profile holds a language's most frequent n-grams in order.  Each of a text's own
most frequent n-grams is out of place by the difference of its two ranks, or by the profile's full length where the
profile lacks it; the language with the least sum wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.words import bounded, texts
from barloom.sources.readers import materialize

#: n-grams of a profile, n-grams of a text, languages that may be learned (their profiles are broadcast), result without letters.
PROFILE, TOP, LANGUAGES, UNKNOWN = 400, 400, 4096, "und"
#: Bytes of text and number of texts that a task looks at together; distinct counts it holds before it sends them.
BATCH, ROWS, HELD = 1 << 22, 4096, 1 << 20
#: Stands for a word's boundary in packed n-grams (21 bits a character); less than every letter.
EDGE = 1


class Counts(NamedTuple):
    """Occurrences by group and packed n-gram, in this order: shorter n-grams first, then by code points."""

    group: np.ndarray
    gram: np.ndarray
    n: np.ndarray

    @classmethod
    def merged(cls, many: list[Counts]) -> Counts:
        group, gram, n = (np.concatenate(x) for x in zip(*many))
        order = np.lexsort((gram, group))
        group, gram, n = group[order], gram[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (gram[1:] != gram[:-1])])[:len(gram)])
        return cls(group[new], gram[new], np.add.reduceat(n, new) if len(new) else n)


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased characters of words with single boundaries around them, the text of each, and whether texts have letters."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    n = len(at) - 1
    table = np.full(int(code.max(initial=0)) + 1, EDGE, np.uint32)
    letter = np.zeros(len(table), bool)
    for c in np.flatnonzero(np.bincount(code)).tolist():  # only the characters that occur
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    text = np.repeat(np.arange(n), np.diff(chars))
    has_letter = np.zeros(n, bool)
    has_letter[text[letter[code]]] = True
    out = np.full(len(code) + 2 * n, EDGE, np.uint32)
    out[np.arange(len(code)) + 2 * text + 1] = table[code]
    keep = out != EDGE
    keep[1:] |= keep[:-1].copy()
    keep[chars[:-1] + 2 * np.arange(n)] = True
    return out[keep], np.repeat(np.arange(n), np.diff(chars) + 2)[keep], has_letter


def count(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[Counts, np.ndarray]:
    """n-grams of texts by the group of each text, and whether texts have letters."""
    chars, text, has_letter = symbols(data, at)
    alphabet = np.flatnonzero(np.bincount(chars, minlength=EDGE + 1))
    bits = int(len(alphabet) + 1).bit_length()
    dense = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet)) + 1
    d, inner, high = dense[chars], chars != EDGE, group[text].astype(np.int64) << (3 * bits)
    pair, triple = inner[:-1] | inner[1:], inner[1:-1]
    two = (d[:-1] << bits) | d[1:]
    keys = np.concatenate([(high | d)[inner], (high[1:] | two)[pair], (high[2:] | (two[:-1] << bits) | d[2:])[triple]])
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    keys, n = keys[new], np.diff(np.append(new, len(keys)))
    back = np.concatenate([[0], alphabet]).astype(np.int64)
    gram = np.zeros(len(keys), np.int64)
    for k in (2, 1, 0):
        gram = (gram << 21) | back[(keys >> (k * bits)) & ((1 << bits) - 1)]
    return Counts(keys >> (3 * bits), gram, n), has_letter


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of at most BATCH bytes, cut before an ASCII byte that is no letter (a boundary anyway), or
    between two characters where a piece has none."""
    at = 0
    while len(data) - at > BATCH:
        window = data[at + 1:at + BATCH]
        cuts = np.flatnonzero((window < 65) | ((window > 90) & (window < 97)) | ((window > 122) & (window < 128)))
        cuts = cuts if len(cuts) else np.flatnonzero((window & 0xC0) != 0x80)
        end = at + 1 + int(cuts[-1])
        yield data[at:end]
        at = end
    yield data[at:]


def counted(column: pa.Array, group: np.ndarray) -> tuple[Counts, np.ndarray]:
    """As ``count``, for a batch of bounded size or one text of any size."""
    data, at = texts(column)
    if len(data) <= BATCH or len(at) > 2:
        return count(data, at, group)
    total, letters = None, np.zeros(1, bool)
    for piece in pieces(data):
        found, has = count(piece, np.array([0, len(piece)]), group)
        total, letters = found if total is None else Counts.merged([total, found]), letters | has
    return total, letters


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, BATCH):
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language: n-grams packed as 21 bits a character, occurrences in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[Counts] = []

        def send(total: Counts) -> pa.RecordBatch:
            langs = pa.array(list(names), pa.string()).take(pa.array(total.group))
            return pa.RecordBatch.from_arrays([langs, pa.array(total.gram), pa.array(total.n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches_of(batches):
            group = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            local, own = np.unique(group, return_inverse=True)
            found, _ = counted(batch.column(0), own)
            held.append(found._replace(group=local[found.group]))
            if sum(len(x.n) for x in held) > 2 * HELD:
                held = [Counts.merged(held)]
                if len(held[0].n) > HELD:
                    yield send(held[0])
                    held = []
        if held:
            yield send(Counts.merged(held))

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, gram, n): each language's most frequent n-grams, ranks from 0, equal counts by the n-gram's order.

    Counts combine before each shuffle and every partition keeps its ``size`` best per language before the last one, so a
    language that holds most of the corpus costs no more than another.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return gram_counts(docs, lang, text).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select(
        "lang", (F.col("rank") - 1).alias("rank"), "gram", "n")


def readable(gram: Column) -> Column:
    """A packed n-gram as text, boundaries as spaces."""
    parts = [F.shiftright(gram, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) for k in (2, 1, 0)]

    def utf8(c: Column) -> Column:
        follow = [F.lit(0x80) + F.shiftright(c, 6 * k).bitwiseAND(F.lit(0x3F)) for k in (2, 1, 0)]
        codes = (F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(F.lit(0xC0) + F.shiftright(c, 6), follow[2]))
                 .when(c < 0x10000, F.array(F.lit(0xE0) + F.shiftright(c, 12), *follow[1:])).otherwise(F.array(F.lit(0xF0) + F.shiftright(c, 18), *follow)))
        return F.decode(F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")

    return F.concat(*[F.when(p == 0, "").when(p == EDGE, " ").otherwise(utf8(p)) for p in parts])


class Profiles(NamedTuple):
    """All profiles, by n-gram."""

    langs: list[str]
    size: int
    gram: np.ndarray  # distinct, sorted
    at: np.ndarray  # the entries of n-gram i are at[i]:at[i + 1]
    lang: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, rows: list, size: int) -> Profiles:
        langs = sorted({r.lang for r in rows}, key=str.encode)
        number = {x: i for i, x in enumerate(langs)}
        entries = np.array(sorted((r.gram, number[r.lang], r.rank) for r in rows), np.int64).reshape(-1, 3)
        gram, first = np.unique(entries[:, 0], return_index=True)
        return cls(langs, size, gram, np.append(first, len(entries)), entries[:, 1], entries[:, 2])

    def closest(self, found: Counts, n_texts: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), least distance and number of n-grams of each text."""
        order = np.lexsort((-found.n, found.group))  # stable: equal counts stay in the n-grams' order
        text, gram = found.group[order], found.gram[order]
        first = np.searchsorted(text, np.arange(n_texts))
        rank = np.arange(len(text)) - first[text]
        text, gram, rank = text[rank < top], gram[rank < top], rank[rank < top]
        n = np.bincount(text, minlength=n_texts)
        saved = np.zeros(n_texts * len(self.langs), np.int64)
        if len(self.gram) and len(gram):
            place = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
            known = self.gram[place] == gram
            text, rank, place = text[known], rank[known], place[known]
            many = self.at[place + 1] - self.at[place]
            entry = np.arange(many.sum()) + np.repeat(self.at[place] - np.cumsum(many) + many, many)
            gain = np.maximum(self.size - np.abs(np.repeat(rank, many) - self.rank[entry]), 0)
            np.add.at(saved, np.repeat(text, many) * len(self.langs) + self.lang[entry], gain)
        if not self.langs:
            return np.full(n_texts, -1), n * self.size, n
        distance = (n * self.size)[:, None] - saved.reshape(n_texts, -1)
        best = distance.argmin(1)
        return np.where(n > 0, best, -1), distance[np.arange(n_texts), best], n


def predict(docs: DataFrame, learned: DataFrame, size: int = PROFILE, top: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score per row of ``docs``.

    ``learned`` holds profiles of at most ``size`` n-grams for at most LANGUAGES languages (more are an error, as they are
    broadcast).  score is 1 - distance / (n-grams of the text * size): 1 for the profile's own order, 0 if nothing is
    shared.  Equal distances give the lesser name.  Texts without a letter, null ones, and all texts where nothing was
    learned give ``und`` and 0.
    """
    if learned.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # plain values, which executors read without this package
    sent = docs.sparkSession.sparkContext.broadcast(tuple(Profiles.of(learned.select("lang", "rank", "gram").collect(), size)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(*sent.value)
        for batch in batches_of(batches):
            found, letters = counted(batch.column(1), np.arange(len(batch)))
            lang, distance, n = known.closest(found, len(batch), top)
            lang = np.where(letters, lang, -1)
            score = np.where(lang >= 0, 1 - distance / np.maximum(n * size, 1), 0.0)
            names = pa.array([known.langs[i] if i >= 0 else UNKNOWN for i in lang.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(score)], [key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """A third of the ids, by CRC-32 of their decimal text; null counts as empty (remainder 0, so it trains)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that are not held out."""
    learned = materialize(profiles(docs.where(~held_out(F.col("doc_id")))), "profiles")
    return predict(docs, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def sql(size: int = PROFILE, top: int = TOP) -> str:
    """The same in SQL: words, their n-grams, ranks and distances as rows."""
    shift = "list_reduce([CAST(x AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return rf"""
WITH bytes AS (SELECT list({shift} ORDER BY x) AS t FROM (SELECT unnest(range(256)) AS x)),
d AS (SELECT doc_id, text, lang, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 3 = 1 AS held_out FROM documents, bytes),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' ')) AS word FROM d WHERE text IS NOT NULL)
      WHERE word <> '' GROUP BY ALL),
v AS (SELECT DISTINCT word FROM w),
g AS (SELECT word, unnest(list_concat(list_concat(list_transform(range(1, length(word) + 1), lambda i: substr(word, i, 1)),
             list_transform(range(1, length(word) + 2), lambda i: substr(' ' || word || ' ', i, 2))), list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))) AS gram FROM v),
c AS (SELECT doc_id, gram, CAST(sum(n) AS BIGINT) AS n FROM w JOIN g USING (word) GROUP BY ALL),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS r FROM c QUALIFY r < {top}),
learned AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 AS p
            FROM (SELECT lang, gram, sum(n) AS n FROM c JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY p < {size}),
size AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
dist AS (SELECT doc_id, l.lang, s.n, s.n * {size} - coalesce(x.saved, 0) AS distance FROM size s CROSS JOIN (SELECT DISTINCT lang FROM learned) l
         LEFT JOIN (SELECT doc_id, lang, sum(greatest({size} - abs(r - p), 0)) AS saved FROM own JOIN learned USING (gram) GROUP BY ALL) x USING (doc_id, lang)),
best AS (SELECT doc_id, lang, n, distance FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\p{{L}}') THEN coalesce(best.lang, 'und') ELSE 'und' END AS lang_pred,
       CASE WHEN regexp_matches(text, '\p{{L}}') AND best.lang IS NOT NULL THEN 1 - CAST(distance AS DOUBLE) / CAST(n * {size} AS DOUBLE) ELSE 0.0 END AS score
FROM d LEFT JOIN best USING (doc_id)"""
