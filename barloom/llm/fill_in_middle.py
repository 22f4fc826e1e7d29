"""Fill-in-the-middle examples from whole texts, cut at code points.

Texts stay UTF-8 bytes.  A batch has one sparse index: the place of each multibyte character and the bytes it has beyond
one.  Between two such places code points and bytes run in step, so a cut is converted by one binary search and one
addition, in either direction; a text of ASCII alone needs no index at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import bounded, texts

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that a task holds at once (one text at least).
BATCH = 1 << 22


class Exceptions(NamedTuple):
    """Multibyte characters of a byte string."""

    at_byte: np.ndarray  # their first bytes, ascending
    at_char: np.ndarray  # the same places in code points
    excess: np.ndarray  # bytes beyond one per character, summed before each of them and in all

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        return cls(at, at - excess[:-1], excess)

    def to_byte(self, char: np.ndarray) -> np.ndarray:
        return char + self.excess[np.searchsorted(self.at_char, char)]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """``byte`` is the first byte of a character, or the end."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]


def draws(key: Column, seed: int = 1, n: int = 4) -> Column:
    """The first ``n`` groups of eight hex digits of sha256("seed:key") as integers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)])


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key, n (code points), form, prefix_chars, middle_chars and output.

    Prefix and middle end at two places drawn from all n + 1, by the key and ``seed``.  Form ``psm`` has prefix, suffix
    and middle in that order, ``spm`` suffix, prefix and middle, each after its mark; ``plain`` is the text itself: for
    ``plain_percent`` of the keys, empty and null texts (output empty), and texts that hold a mark, which could not be
    rebuilt.  Every row stands for itself, so repeated rows give equal rows, and equal keys with different texts are cut
    each by its own length.  Other columns are left behind.
    """
    m = [x.encode() for x in marks]
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, BATCH):
            data, at = texts(batch.column(1))
            h = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            index = Exceptions.of(data)
            chars = index.to_char(at)
            n = np.diff(chars)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            first, second = np.minimum(one, two), np.maximum(one, two)
            cut1, cut2 = index.to_byte(chars[:-1] + first), index.to_byte(chars[:-1] + second)
            whole = data.tobytes()
            forms, outputs = [], []
            for a, b, c, d, plain, spm in zip(at.tolist(), cut1.tolist(), cut2.tolist(), at[1:].tolist(),
                                              (h[:, 2] % 100 >= 100 - plain_percent).tolist(), (h[:, 3] % 100 < spm_percent).tolist()):
                own = whole[a:d]
                if plain or not own or any(x in own for x in m):
                    forms.append("plain")
                    outputs.append(own)
                elif spm:
                    forms.append("spm")
                    outputs.append(b"".join((m[1], whole[c:d], m[0], whole[a:b], m[2], whole[b:c])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((m[0], whole[a:b], m[1], whole[c:d], m[2], whole[b:c])))
            cut = pa.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(forms, pa.string()), _unless(cut, first), _unless(cut, second - first),
                 pa.array(outputs, pa.binary()).cast(pa.string())], [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key), F.col(text).alias("text"), draws(F.col(key), seed).alias("h"))
    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _unless(gone: pa.Array, values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=gone.to_numpy(zero_copy_only=False))


def parts(output: bytes, form: str, marks: list[bytes]) -> tuple[int, int, int, int, int]:
    """Bytes of an output: start and end of the prefix, start of the middle, start and end of the suffix."""
    p, s, m = marks
    if form == "plain":
        return 0, len(output), len(output), len(output), len(output)
    if form == "psm":
        at_s = output.index(s, len(p))
        at_m = output.index(m, at_s + len(s))
        return len(p), at_s, at_m + len(m), at_s + len(s), at_m
    at_p = output.index(p, len(s))
    at_m = output.index(m, at_p + len(p))
    return at_p + len(p), at_m, at_m + len(m), len(s), at_p


def restore(examples: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds ``restored``, the text rebuilt from output and form alone, and the code points that prefix and middle have in
    the output (restored_prefix, restored_middle; null if plain).  A null output counts as empty, a null form as plain."""
    m = [x.encode() for x in marks]
    names = [c for c in examples.columns if c not in ("restored", "restored_prefix", "restored_middle")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, BATCH, "output"):
            data, at = texts(batch.column(names.index("output")))
            forms = batch.column(names.index("form")).fill_null("plain").to_pylist()
            index, whole = Exceptions.of(data), data.tobytes()
            out, places = [], np.zeros((len(forms), 4), np.int64)
            for i, (a, b, form) in enumerate(zip(at.tolist(), at[1:].tolist(), forms)):
                own = whole[a:b]
                p, p_end, mid, s, s_end = parts(own, form, m)
                out.append(own[p:p_end] + own[mid:] + own[s:s_end] if form != "plain" else own)
                places[i] = a + p, a + p_end, a + mid, b
            chars = index.to_char(places)
            plain = pa.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(out, pa.binary()).cast(pa.string()),
                                              _unless(plain, chars[:, 1] - chars[:, 0]), _unless(plain, chars[:, 3] - chars[:, 2])],
                                             [*names, "restored", "restored_prefix", "restored_middle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*names).schema)
    return examples.select(*names).mapInArrow(run, f"{schema}, restored string, restored_prefix bigint, restored_middle bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: hashes of the outputs and of the texts rebuilt from them."""
    rows = restore(transform(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def sql() -> str:
    """The digest in plain substrings."""
    draw = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, {draw} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
