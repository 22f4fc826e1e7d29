import hashlib
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import fill_in_middle, language_id, vector_codes
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


# languages


def brute_grams(text):
    chars = [chr(c) if len(low := ch.lower()) != 1 else low for ch in text or "" for c in [ord(ch)]]
    kinds = [unicodedata.category(ch)[0] for ch in text or ""]
    words = "".join(c if k in "LM" else " " for c, k in zip(chars, kinds)).split(" ")
    out = Counter()
    for w in (w for w in words if w):
        p = " " + w + " "
        out.update(w)
        out.update(p[i:i + 2] for i in range(len(p) - 1))
        out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out, "L" in kinds


def packed(gram):
    value = 0
    for ch in gram:
        value = value << 21 | (1 if ch == " " else ord(ch))
    return value


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))[:size]]


def brute_languages(rows, size=language_id.PROFILE, top=language_id.TOP):
    found = [(i, *brute_grams(t), lang, t) for i, t, lang in rows]
    held = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 3 == 1 for i, *_ in rows}
    learned = {}
    for i, grams, _, lang, text in found:
        if not held[i] and lang is not None and text is not None:
            learned.setdefault(lang, Counter()).update(grams)
    learned = {k: {g: r for r, g in enumerate(ranked(v, size))} for k, v in learned.items() if v}
    out = []
    for i, grams, letters, _, _ in found:
        own = ranked(grams, top)
        best = min((sum(abs(r - p[g]) if g in p else size for r, g in enumerate(own)), lang) for lang, p in learned.items()) if learned and letters else None
        out.append((i, held[i], best[1] if best else "und", 1 - best[0] / (len(own) * size) if best else 0.0))
    return sorted(out, key=str)


ODD_ROWS = [
    (0, "The cat and the dog. THE END", "en"), (3, "Der Hund und die Katze, ÄÖÜ ß", "de"), (4, "", "en"), (5, None, "de"), (6, "12 345 !?", None), (7, "日本語のテキスト です", "ja"),
    (8, "the dog", None), (8, "the dog", None), (9, "́́", "en"), (10, "Σίσυφος İstanbul \U0001d400\U0001d401", "el"), (11, "der die das", "en"), (None, "the the", "en"), (12, "a", "en"),
    (13, "\x00\x01 \x02", "x"), (14, "Katze " * 50, "de"), (15, "x" * 300, "en"), (16, "die", ""), (17, "zwölf", "de"),
]


def test_languages_are_those_of_brute_force(spark):
    rows = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string").withColumn("gram", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.identify(rows).collect()), key=str)
    assert got == brute_languages(ODD_ROWS)


def test_profiles_are_ranked_and_readable(spark):
    rows = spark.createDataFrame([("Ab ab, éa 日本 \U0001d400", "l"), ("ab", "l"), (None, "l"), ("ab", None)], "text string, lang string")
    got = language_id.profiles(rows, 12).withColumn("text", language_id.readable(F.col("gram"))).orderBy("rank").collect()
    want, _ = brute_grams("Ab ab, éa 日本 \U0001d400 ab")
    assert [(r.text, r.n) for r in got] == [(g, want[g]) for g in ranked(want, 12)]


def test_no_languages_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty).collect() == []
    rows = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(rows).collect()] == [("und", 0.0)]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.identify(spark.createDataFrame([(i, "a", f"l{i}") for i in range(9)], "doc_id long, text string, lang string"))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Über den Wolken, the end; " * 40 + "ñ" * 70 + " fin"
    column = pa.array([text])
    whole, _ = language_id.counted(column, np.zeros(1, np.int64))
    monkeypatch.setattr(language_id, "BATCH", 300)
    parts, letters = language_id.counted(column, np.zeros(1, np.int64))
    assert letters[0] and all((a == b).all() for a, b in zip(whole, parts))
    assert b"".join(p.tobytes() for p in language_id.pieces(np.frombuffer(("é" * 400).encode(), np.uint8))).decode() == "é" * 400


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_language_id"](spark, SF).where("held_out").join(docs, "doc_id")
    right, n = got.where("length(text) >= 40").agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 2500 and right / n > 0.98


# fill in the middle


MIXED = st.lists(st.sampled_from(["a", "bc", "é", "日本", "\U0001f600", "<", "<P", "S>", "M>", "\n", "<P>", "́", ""]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=5))
def test_cuts_between_code_points_and_bytes(texts):
    whole = "".join(texts)
    data = np.frombuffer(whole.encode(), np.uint8)
    index = fill_in_middle.Exceptions.of(data)
    chars = np.arange(len(whole) + 1)
    want = np.array([len(whole[:i].encode()) for i in chars])
    assert (index.to_byte(chars) == want).all() and (index.to_char(want) == chars).all()
    assert len(index.at_byte) == sum(ord(c) > 127 for c in whole)


def brute_example(key, text):
    text, n = text or "", len(text or "")
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_in_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_examples_are_those_of_brute_force_and_round_trip(spark):
    texts = ["", None, "a", "é", "plain ascii text", "日本語 mixed \U0001f600 text", "has <P> mark", "<S><", "<<P", "S> <M", "x" * 50_000 + "é" * 50_000, "\n"]
    rows = [(i if i % 29 else None, texts[i % len(texts)], 7, "q") for i in range(240)] + [(5, "tie", 1, "r"), (5, "tie", 1, "r"), (5, "other text", 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    done = fill_in_middle.restore(fill_in_middle.transform(docs)).collect()
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done], key=str)
    assert got == sorted([(i, *brute_example(i, t), t or "") for i, t, *_ in rows], key=str)
    assert all((r.restored_prefix, r.restored_middle) == (r.prefix_chars, r.middle_chars) for r in done)
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).collect() == []


def test_other_rates_and_text_ids(spark):
    docs = spark.createDataFrame([(f"id {i}", "some text to be cut é") for i in range(60)], "name string, body string")
    every = fill_in_middle.transform(docs, seed=2, plain_percent=0, spm_percent=100, marks=("[p]", "[s]", "[m]"), key="name", text="body")
    assert {r.form for r in every.collect()} == {"spm"}
    assert {r.restored for r in fill_in_middle.restore(every, ("[p]", "[s]", "[m]")).collect()} == {"some text to be cut é"}


# vector codes


def brute_codes(rows, parts, entries, rounds):
    keep = [(k, [int(np.floor(256.0 * x)) for x in v], lab) for k, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    width = len(keep[0][1]) // parts

    def piece(v, p):
        return v[p * width:(p + 1) * width]

    books = [[piece(v, p) for _, v, _ in keep[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(piece(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            groups = {}
            for _, v, _ in keep:
                groups.setdefault(nearest(v, p)[1], []).append(piece(v, p))
            for i, g in groups.items():
                new[p][i] = [sum(c) // len(g) for c in zip(*g)]
        books = new
    out = [(k, "".join(f"{nearest(v, p)[1]:02x}" for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts)), lab) for k, v, lab in keep]
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted([(k, c, e, total[lab]) for k, c, e, lab in out], key=str), books


def vectors(seed, n, dim, grid):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)) if not grid else rng.integers(-2, 3, (n, dim)) / 256
    return [[float(x) for x in v] for v in points]


@pytest.mark.parametrize("grid", [False, True])
def test_codes_are_those_of_brute_force(spark, grid):
    rows = [(i * 3 % 200, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors(1, 160, 32, grid))]
    rows += [(500, None, 1), (501, [1.0] * 31 + [None], 1), (502, [float("nan")] * 32, None), (503, [float("inf")] * 32, 2), (504, [], 1), (None, rows[0][1], None), (7, rows[3][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("_label", F.lit(2))
    got = vector_codes.digest(table).collect()
    want, books = brute_codes(rows, 16, 64, 2)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == want
    assert {r.codebooks_sha256 for r in got} == {vector_codes.fingerprint([np.array(b) for b in books])}


def test_few_rows_other_lengths_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rows = [(1, [0.5] * 32, "a"), (2, [0.25] * 32, None), (3, [0.1] * 16, "a"), (4, [0.1] * 30, "a"), (5, [1e9] * 32, "a")]
    got = vector_codes.digest(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]
    assert vector_codes.digest(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.digest(spark.createDataFrame([(1, None, "a")], schema)).collect() == []


def test_decoded_vectors_are_the_entries(spark):
    rows = [(i, v) for i, v in enumerate(vectors(2, 40, 8, False))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = vector_codes.train(table, parts=4, entries=40, rounds=0)
    got = vector_codes.decode(vector_codes.encode(table, books), books).collect()
    assert all(r.error == 0 and r.vector == [np.floor(256 * x) / 256 for x in rows[r.vec_id][1]] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 90), st.integers(1, 4), st.sampled_from([2, 30, 10**7]))
def test_trees_find_the_first_nearest_entry(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(-spread, spread + 1, (n, dim)), rng.integers(-spread, spread + 1, (50, dim))
    queries[:20] = points[rng.integers(0, n, 20)]
    index, squares = vector_codes.Gnat(points).nearest(queries)
    every = ((queries[:, None] - points[None]) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (squares == every.min(1)).all()


def test_trees_skip_entries():
    rng = np.random.default_rng(3)
    points, queries = rng.normal(0, 1000, (512, 3)).astype(np.int64), rng.normal(0, 1000, (1000, 3)).astype(np.int64)
    tree = vector_codes.Gnat(points)
    tree.nearest(queries)
    assert tree.compared < 0.4 * len(points) * len(queries)
