import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import harness
from barloom.llm import chat, lm_scoring, quality_classifier, quality_rules, warc
from barloom.llm.blocks import distinct_values, in_blocks
from barloom.llm.queries import QUERIES, SQL
from barloom.llm.words import WORD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    message, _, ok = harness.compare(spark, harness.duck(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# quality rules


def brute_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, documents):
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "a a a a", "x y z x y z", "é ü ñ b", "#1 $2 <b>|\n#1 $2 <b>|\n\n \nq", "a b\x0bc\x0cd\x1ce", "w " * 30_000]
    texts += [" ".join(rng.choices("abcde", k=rng.randint(1, 40))) for _ in range(60)]
    got = quality_rules.features(documents(list(enumerate(texts))))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert {r.doc_id: tuple(r[c] for c in names) for r in got.collect()} == {i: brute_counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,p", [(1, 0.3), (50, 0.02), (3000, 0.005), (3000, 0.4)])
def test_binomial_tail(spark, n, p):
    ks = [k for k in {0, 1, 2, int(n * p) // 2, int(n * p)} if k <= n * p]
    rows = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select("k", quality_rules.log_at_most(F.col("k"), F.col("n"), p).alias("x")).collect()
    for r in rows:
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(r.k + 1)]
        assert r.x == pytest.approx(max(terms) + math.log(math.fsum(math.exp(t - max(terms)) for t in terms)), abs=1e-7)


def test_cutoffs_limit_false_rejection(spark):
    """No stratum's rules reject more of its good documents than allowed; one with some hundred labels has
    cutoffs of its own, one with few has none."""
    rng = np.random.default_rng(4)
    rows = [("big", 100, 500, int(max(0, rng.normal(5, 4))), 5, 0, 0, True) for _ in range(4000)] + [("small", 100, 500, 0, 5, 0, 0, True)] * 20 + [("medium", 100, 500, 0, 5, 0, 0, True)] * 300
    rows += [("big", 100, 500, 400, 5, 0, 0, False)] * 100
    labelled = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, good boolean")
    found = {r.stratum: r for r in quality_rules.cutoffs(labelled, "stratum").collect()}
    assert set(found) == {"big", "medium"} and not any(r.pooled for r in found.values())
    names = [name for name, *_ in quality_rules.RULES]
    assert all(found[k][name] is not None for k in found for name in names)
    for k, n in (("big", 4000), ("medium", 300)):
        rejected = sum(any(100 * r[a] > found[k][name] * r[b] for name, a, b, _ in quality_rules.RULES)
                       for r in labelled.where(F.col("stratum") == k).where("good").collect())
        assert found[k].n_good == n and rejected <= 0.02 * n
    assert 3 <= found["big"].symbols <= 8


def test_rules_on_odd_rows(spark, documents):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, "few words")]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (9, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(documents(rows), labels).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in got) == sorted(
        [("1", True, False), ("2", True, False), ("3", False, True), ("3", False, True), ("None", False, True), ("4", True, False)])
    assert quality_rules.judge(documents(rows).limit(0), labels).count() == 0
    assert quality_rules.judge(documents(rows), labels.limit(0)).where("kept").count() == 3
    kept = quality_rules.kept_documents(documents(rows), labels)
    assert kept.columns == documents(rows).columns and {r.doc_id for r in kept.collect()} == {3, None}


def test_sparse_languages_are_judged_together(spark, documents):
    """Three languages, none of which has the good documents that a bound of its own needs."""
    clean, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i} #$%*&|<>" for i in range(60))
    for n in (100, 500):  # the pool allows one test for all rules, or one for each
        rows = [(10_000 * k + i, junk if i >= n else clean, lang, "s") for k, lang in enumerate(("de", "fr", "es")) for i in range(n + 5)] + [(99_999, junk, "xx", "s")]
        labels = spark.createDataFrame([(r[0], int(r[1] == clean), 0) for r in rows], "doc_id long, quality int, toxic int")
        kept = {r.doc_id for r in quality_rules.kept_documents(documents(rows), labels).collect()}
        # a language without a good document has no certificate
        assert kept == {r[0] for r in rows if r[1] == clean} | {99_999}


# quality classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    test = labels.where("doc_id % 3 = 0")
    got = quality_classifier.classify(docs, labels.where("doc_id % 3 <> 0")).join(test, "doc_id").collect()
    wrong = sum(r.kept != (r.quality == 1 and r.toxic == 0) for r in got)
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert len(got) > 100 and wrong <= 0.08 * len(got) and sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_sites_are_shrunk_toward_their_parents(spark):
    rows = [("big", "a", 1.0, float(i % 10 > 0)) for i in range(1000)] + [("bad", "a", 1.0, float(i % 10 == 0)) for i in range(1000)]
    rows += [("bad", "b", 1.0, 1.0), ("new", "a", 1.0, 1.0)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, path string, weight double, good_weight double")
    rate = {(r.host, r.path): r.site_rate for r in quality_classifier.posteriors(scored).collect()}
    assert rate["big", "a"] == pytest.approx(0.9, abs=0.02) and rate["bad", "a"] == pytest.approx(0.1, abs=0.02)
    assert rate["bad", "b"] < 0.5 < rate["new", "a"] < 0.9


def test_classifier_on_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (2, ""), (None, "text here"), (3, "x " * 100_000)]
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(documents(rows), labels).count() == 5
    bare = quality_classifier.classify(documents(rows), labels.limit(0)).collect()
    assert all(r.kept and r.evidence == 0 for r in bare)
    assert quality_classifier.classify(documents(rows).limit(0), labels).count() == 0


# archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choice("abc<>\r\n é日") for _ in range(60_000))
    trap = "x" * 990 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3
    pages = [(1, "u", None), (2, None, ""), (3, "u\r\nv", "a" * 999), (4, "u", "a" * 999), (5, "u", "b" * 1000), (6, "u", "b" * 1000), (6, "u", "b" * 1000),
             (7, "u", big), (8, "u", big), (9, "u", big + "é"), (10, "u", trap), (None, "u", trap), (11, "u", "é" * 500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for name, segment in (("a", 16_384), ("b", 700)):
        warc.write(df, str(tmp_path / name), segment)
        got = warc.read(spark, str(tmp_path / name)).collect()
        assert len(got) == len(pages) and all(r.complete for r in got)
        target = {}
        for k, _, t in pages:
            if len((t or "").encode()) >= 1000:
                target[t] = max(target.get(t, -1), -1 if k is None else k)
        want = Counter()
        for k, u, t in pages:
            raw = (t or "").encode()
            revisit = t in target and target[t] != k
            want[k, " ".join((u or "").split()), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target[t] if revisit else None, None if revisit else raw] += 1
        assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_a_lost_segment_is_noticed(spark, tmp_path):
    """Archives of another writer: gzip member per record, segments in any order and files; one misses a segment."""
    import gzip

    body = b"4\r\nWiki\r\n7;x=y\r\npedia i\r\nB\r\nn \r\nchunks.\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    digest = __import__("base64").b32encode(hashlib.sha1(b"Wikipedia in \r\nchunks.").digest()).decode()

    def record(kind, part, **headers):
        lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
        return gzip.compress(f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(part)}\r\n\r\n".encode() + part + b"\r\n\r\n")

    files = {"x": [], "y": []}
    for page, lost in ((1, False), (2, True)):
        name = f"<urn:{page}>"
        first = record("response", block[:30], WARC_Record_ID=name, X_Page_ID=page, WARC_Payload_Digest="sha1:" + digest, WARC_Segment_Number=1)
        second = record("continuation", block[30:60], WARC_Record_ID=f"<urn:{page}b>", WARC_Segment_Origin_ID=name, WARC_Segment_Number=2)
        third = record("continuation", block[60:], WARC_Record_ID=f"<urn:{page}c>", WARC_Segment_Origin_ID=name, WARC_Segment_Number=3, WARC_Segment_Total_Length=len(block))
        files["x"] += [third, first]
        files["y"] += [] if lost else [second]
    (tmp_path / "w").mkdir()
    for name, parts in files.items():
        (tmp_path / "w" / f"{name}.warc.gz").write_bytes(record("warcinfo", b"software: x") + b"".join(parts))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert bytes(got[1].payload) == b"Wikipedia in \r\nchunks." and got[1].complete and not got[2].complete


def test_archives_of_others(spark, tmp_path):
    """Foreign digests, missing lengths and ends, numbers that are none, padding, broken members, broken framing."""
    import base64
    import gzip

    def record(kind, block, size=None, **headers):
        lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
        length = "" if size == "none" else f"Content-Length: {len(block) if size is None else size}\r\n"
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}{length}\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha = hashlib.sha1(b"body")
    page = lambda n, block=http + b"body", size=None, **h: record("response", block, size, X_Page_ID=n, **h)
    hexed, based = "sha1:" + sha.hexdigest(), "SHA1:" + base64.b32encode(sha.digest()).decode().lower()
    plain = b"".join([
        page(1, WARC_Payload_Digest=hexed), page(2, WARC_Payload_Digest=based), page(3, WARC_Payload_Digest="sha256:" + "0" * 64), page(4),
        page(5, WARC_Payload_Digest="sha1:" + "0" * 40), page(6, size="none"), page(7, size="ten"), page(8, size=-4),
        page(9, http.replace(b"A: b", b"Transfer-Encoding:Chunked") + b"4\r\nbody\r\n-5\r\nxx\r\n", WARC_Payload_Digest=hexed),
        page("ten", WARC_Segment_Number="two"), page(9 ** 30), b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 12\r\n", page(13),
        page(14, b"no WARC/1.0\r\nheader WARC/", WARC_Segment_Number=1, WARC_Record_ID="<o>"), page(15, size=1000)])
    members = [page(k) for k in range(20, 40)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(plain + b"WARC/1.1\r\nX-Page-ID: 16")
    broken = bytearray(gzip.compress(page(98)))
    broken[12:20] = b"\xff" * 8
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, members)) + b"\0" * 70000 + bytes(broken) + gzip.compress(page(41)) + gzip.compress(page(42, http + random.Random(1).randbytes(9000)))[:5000])
    (tmp_path / "w" / "c.warc").write_bytes(b"")
    got = {r.page_id: (bytes(r.payload), r.complete) for r in warc.read(spark, str(tmp_path / "w")).collect() if r.page_id is not None}
    body = (b"body", True)
    want = {1: body, 2: body, 3: body, 4: body, 5: (b"body", False), 9: body, 13: body, 14: (b"no WARC/1.0\r\nheader WARC/", False), **{k: body for k in range(20, 40)}, 41: body}
    assert {k: v for k, v in got.items() if k not in (15, 42)} == want
    assert not got[15][1] and not got[42][1] and 0 < len(got[42][0]) < 9000
    kinds = Counter(r.kind for r in warc.records(spark, str(tmp_path / "w")).collect())
    assert kinds["damaged"] == 4
    assert sum(r.page_id is None for r in warc.read(spark, str(tmp_path / "w")).collect()) == 2


def test_members_are_unpacked_in_linear_time():
    import gzip
    import time

    one = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + random.Random(2).randbytes(300))
    begin = time.perf_counter()
    assert len(warc._plain(memoryview(one * 40000))) == 40000 * len(gzip.decompress(one))
    assert time.perf_counter() - begin < 20


# language model


def test_scores(spark, documents):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None), (5001, ""), (5002, None), (5002, None)]
    got = lm_scoring.score(documents(rows)).collect()
    tokens = [(k, re.findall(WORD, (t or "").translate(LOWER)) + [None]) for k, t in rows]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows}
    c = Counter(w for k, t in tokens if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    want = {k: (held[k], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for k, t in tokens}
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == want and len(got) == len(rows)
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) and all(r.score < 0 for r in got)
    assert lm_scoring.score(documents(rows).limit(0)).count() == 0


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "a dog ran in the park", "the end of a day", "das ist ein Haus und ein Baum"] * 5
    t = lm_scoring.tokens(pa.array(texts))
    tables = np.zeros((lm_scoring.CONTEXTS, 1 << lm_scoring.CONTEXT, 1 << lm_scoring.CODE), np.uint64)
    for k in range(lm_scoring.CONTEXTS):
        np.add.at(tables[k], (t.contexts[k], t.code), 1)
    mixer = lm_scoring.Mixer(tables)
    mixer.learn(t)
    every = np.arange(1 << lm_scoring.CODE, dtype=np.int32)
    for i in (0, 3, 17):
        contexts = np.repeat(t.contexts[:, i:i + 1], len(every), 1)
        p = 10 ** mixer.log10(lm_scoring.Tokens(every, every, every, contexts, every, every))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_higher_orders_sum_to_one():
    """Over all words, whatever follows a context: nothing, few words, many."""
    rng = np.random.default_rng(3)
    strengths = lm_scoring.STRENGTHS[rng.integers(0, len(lm_scoring.STRENGTHS), (2, lm_scoring.LEVELS))]
    lowest = rng.dirichlet(np.ones(50))
    for most in (0, 1, 3, 400):
        follow = [rng.integers(0, most + 1, 50).astype(float) for _ in range(2)]
        totals = tuple(np.full(50, f.sum()) for f in follow)
        p = lm_scoring.raised(lowest, lm_scoring.Counted(lowest, tuple(follow), totals), strengths)
        assert p.sum() == pytest.approx(1) and (p > 0).all()
        assert most or (p == pytest.approx(lowest))


def test_documents_that_occur_twice_cost_less(spark, documents):
    """The words after two words are counted, not slots of a table: a copy anywhere in the corpus shows."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(120))
    train = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 != 1][:600]
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 1][:40]
    rows = {k: text() for k in train}
    twice = train[:20]
    rows.update({b: rows[a] for a, b in zip(twice, train[100:120])})
    rows.update({k: rows[train[300 + i]] if i < 20 else text() for i, k in enumerate(held)})
    got = {r.doc_id: r.bits_per_byte for r in lm_scoring.score(documents(list(rows.items()))).collect()}
    once = [k for i, k in enumerate(train) if 120 <= i < 300 or i >= 320]
    assert max(got[k] for k in [*twice, *train[100:120]]) < 0.5 * min(got[k] for k in once)
    assert max(got[k] for k in held[:20]) < 0.5 * min(got[k] for k in held[20:])


def test_distinct_values():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 60, 2000), rng.integers(0, 1 << 62, 2000), np.repeat(rng.integers(0, 1 << 62, 500), 7), np.zeros(0), [5]):
        values = np.array(values).astype(np.uint64)
        values = np.concatenate([values, values | np.uint64(1 << 63)])
        rng.shuffle(values)
        for a, b in zip(distinct_values(values), np.unique(values, return_index=True, return_inverse=True)):
            assert (a == b).all()


def test_long_documents_train_the_weights(spark, documents, monkeypatch):
    """Every training document, here all above 16 KiB and in several blocks, has its part in the mixer."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 17)
    rng = random.Random(5)
    follow = {f"w{i}x": [f"w{rng.randrange(300)}x" for _ in range(3)] for i in range(300)}
    rows = []
    for k in range(20):
        word, text = "w0x", []
        for _ in range(5000):
            word = rng.choice(follow[word])
            text.append(word)
        rows.append((k, " ".join(text)))
    docs = documents(rows)
    blocked = in_blocks(docs.select("doc_id", "text"), -(-sum(len(t) for _, t in rows) // (1 << 17))).collect()
    train = [r for r in sorted(blocked, key=lambda r: r.doc_id) if lm_scoring.training([r.doc_id])[0]]
    every = lm_scoring.tokens(pa.array([r.text for r in train]))
    tables = np.zeros((lm_scoring.CONTEXTS, 1 << lm_scoring.CONTEXT, 1 << lm_scoring.CODE), np.uint64)
    for k in range(lm_scoring.CONTEXTS):
        np.add.at(tables[k], (every.contexts[k], every.code), 1)
    sums, online = [0.0, 0, 0.0, 0], {}
    for b in {r.block for r in train}:
        mixer = lm_scoring.Mixer(tables)
        seen, reached, predicted = mixer.learn(lm_scoring.tokens(pa.array([r.text for r in train if r.block == b])))
        online[b] = predicted
        sums = [a + b for a, b in zip(sums, (mixer.weights * seen[:, None], seen, mixer.refined * reached, reached))]
    assert len({r.block for r in train}) > 1
    mixer = lm_scoring.Mixer(tables)
    mixer.weights[sums[1] > 0] = (sums[0] / np.maximum(sums[1], 1)[:, None])[sums[1] > 0]
    mixer.refined[sums[3] > 0] = (sums[2] / np.maximum(sums[3], 1))[sums[3] > 0]
    counts, n, v = Counter(every.hashes.tolist()), len(every.hashes), len(set(every.hashes.tolist()))
    total, distinct = Counter(every.code.tolist()), Counter(c for _, c in set(zip(every.hashes.tolist(), every.code.tolist())))

    # the two orders above, with counters over words and a loop over tokens
    seqs = {r.doc_id: ["", "", *r.text.split(), ""] for r in train}
    after = [Counter((s[i - 1], s[i]) for s in seqs.values() for i in range(2, len(s))), Counter(tuple(s[i - 2:i + 1]) for s in seqs.values() for i in range(2, len(s)))]
    seen_before = [Counter(s[i - 1] for s in seqs.values() for i in range(2, len(s))), Counter((s[i - 2], s[i - 1]) for s in seqs.values() for i in range(2, len(s)))]
    word = {h: w for s in seqs.values() for w, h in zip(s[2:], lm_scoring.tokens(pa.array([" ".join(s[2:])])).hashes.tolist())}
    single = {w: (counts[h], total[x], distinct[x]) for t in [every] for h, x in zip(t.hashes.tolist(), t.code.tolist()) for w in [word[h]]}
    options, likely = [0.25, 1, 2, 4, 8, 16, 64, 256], [{}, {}]

    def places(s):
        return [((s[i - 1], s[i]), s[i - 1], tuple(s[i - 2:i + 1]), (s[i - 2], s[i - 1])) for i in range(2, len(s))]

    def best(table):
        return {level: options[max(range(8), key=lambda j: sums[j])] for level, sums in table.items()}

    for b in online:
        toks = [(s[2 + i], p) for r in train if r.block == b for s in [seqs[r.doc_id]] for i, p in enumerate(places(s))]
        low = [(single[w][0] - 0.5) / (single[w][1] + 0.5 * single[w][2]) * q for (w, _), q in zip(toks, online[b])]
        for k in range(2):
            mine = {}
            pairs = [(after[k][p[2 * k]] - 1, seen_before[k][p[2 * k + 1]] - 1) for _, p in toks]
            for (x, y), q in zip(pairs, low):
                row = mine.setdefault(y.bit_length(), [0.0] * 8)
                for j, o in enumerate(options):
                    row[j] += math.log((x + o * q) / (y + o))
            for level, row in mine.items():
                likely[k][level] = [a + c for a, c in zip(likely[k].get(level, [0.0] * 8), row)]
            s_of = best(mine)
            low = [(x + s_of[y.bit_length()] * q) / (y + s_of[y.bit_length()]) for (x, y), q in zip(pairs, low)]
    strengths = [best(t) for t in likely]
    assert all(len(t) > 2 for t in strengths)

    def raise_orders(s, low, own):
        for k in range(2):
            for i, p in enumerate(places(s)):
                y = seen_before[k][p[2 * k + 1]] - own
                o = strengths[k].get(y.bit_length(), options[0])
                low[i] = (after[k][p[2 * k]] - own + o * low[i]) / (y + o)
        return np.array(low)

    got = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    for doc_id, text in rows:
        t = lm_scoring.tokens(pa.array([text]))
        c = np.array([counts[h] for h in t.hashes.tolist()])
        share = np.array([(counts[h] + 0.5) / (total[x] + 0.5 * distinct[x]) for h, x in zip(t.hashes.tolist(), t.code.tolist())])
        assert (c > 0).all()
        p = raise_orders(["", "", *text.split(), ""], (share * 10 ** mixer.log10(t)).tolist(), int(doc_id in seqs))
        assert got[doc_id] == pytest.approx((np.log10(p) + np.log10(1 - 0.5 / (n + 0.5 * (v + 1)))).sum(), rel=1e-6)


# conversations


def test_quotes_are_linked_and_removed(spark):
    a, b = "First point. Second point!\nThird one?", "I agree with that. Really so."
    quoted_a = "\n".join("> " + x for x in a.split("\n"))
    mails = [
        (1, "t", 1, a), (2, "t", 2, f"{b}\n\nOn Monday A wrote:\n{quoted_a}"),
        (3, "t", 3, "And me\n> I agree with that.\n> Really so.\n> > First point. Second\n>> point! Third one?"),
        (4, "t", 4, "To a lost mail\n> never seen before.\n>> first   point."), (5, "t", 5, "No quote at all"), (6, None, 6, f"Elsewhere\n{quoted_a}"),
        (7, "t", 7, None), (8, "t", 8, ""), (9, "u", 0, f"Too early\n{quoted_a}"), (None, "t", 9, f"No id\n{quoted_a}"), (5, "t", 5, "No quote at all"),
        (10, "t", 10, "Reply\n> Elsewhere\n> and\n> No quote at all")]
    df = spark.createDataFrame([(*m, 1) for m in mails], "id long, thread string, rank long, text string, depth int")
    got = chat.conversations(df)
    rows = {r.id: r for r in got.collect()}
    assert got.count() == len(mails) and rows[2].own == b and rows[1].own == a and rows[7].own is None and rows[8].own == ""
    assert {k: (r.parent_id, r.root_id, r.depth) for k, r in rows.items()} == {
        1: (None, 1, 0), 2: (1, 1, 1), 3: (2, 1, 2), 4: (1, 1, 1), 5: (None, 5, 0), 6: (1, 1, 1), 7: (None, 7, 0), 8: (None, 8, 0), 9: (None, 9, 0),
        None: (None, None, 0), 10: (None, 10, 0)}
    assert chat.conversations(df.limit(0)).count() == 0


def test_turns_with_gaps_repeats_and_odd_numbers(spark):
    rows = [(1, 0, "Start here. First."), (1, 1, "An answer."), (1, 1, "Another answer."), (1, 2, "Third."), (1, 4, "After a gap."), (1, 5, None), (1, 6, "After a null."),
            (2, 1 << 20, "Too far."), (3, 0, "Its own thread."), (4, -1, "Before the start."), (None, 0, "Lost."), (5, None, "No turn."), (1 << 50, 0, "Wide.")]
    turns = spark.createDataFrame([(c, t, "user", x, "n") for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string, _1 string").drop("_1")
    mails = chat.quoting(turns)
    texts = {(r.conv_id, r.turn): r.text for r in mails.where("text is null or not text like 'Another%'").collect()}
    assert len(texts) == len(rows) - 1 and texts[1, 5] is None and texts[1, 4] == "After a gap." and texts[1, 6] == "After a null."
    assert texts[1, 2] == "Third.\n\nOn the day before they wrote:\n> An answer.\n> > Start here. First."
    got = chat.conversations(mails).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append((r.id, r.parent_id, r.root_id, r.depth, r.own))
    at = 1 << 20
    assert sorted(by[1, 1]) == [(at + 1, at, at, 1, "An answer."), (at + 1, at, at, 1, "Another answer.")]
    assert by[1, 2] == [(at + 2, at + 1, at, 2, "Third.")] and by[1, 4] == [(at + 4, None, at + 4, 0, "After a gap.")]
    assert by[1, 5] == [(at + 5, None, at + 5, 0, None)] and by[3, 0][0][:4] == (3 * at, None, 3 * at, 0)
    for key in ((2, 1 << 20), (4, -1), (None, 0), (5, None), (1 << 50, 0)):
        assert by[key][0][:4] == (None, None, None, 0)


def test_copies_of_a_thread_stay_apart(spark):
    turns = [(c, t, "user", f"Turn number {t} says this. And more of {t}.") for c in range(20) for t in range(12)]
    mails = chat.quoting(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = chat.conversations(mails).collect()
    assert all(r.root_id == r.conv_id << 20 and r.depth == r.turn and (r.parent_id is None) == (r.turn == 0) for r in got) and len(got) == 240


# pipeline


def test_stages_by_brute_force(spark):
    import corpus_pipeline
    from test_duplicates import brute_components, brute_leaks

    out = corpus_pipeline.run(spark, SF).collect()
    con = harness.duck(SF)
    docs = {r[0]: r for r in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op2_quality_rules']}) WHERE kept").fetchall()}
    con.execute(f"CREATE TABLE kept AS SELECT * FROM documents WHERE doc_id IN ({','.join(map(str, kept))})")
    digests = dict(con.execute("SELECT doc_id, text_sha256 FROM (" + SQL["op10_line_dedup"].replace("FROM documents", "FROM kept") + ")").fetchall())
    lines = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(kept))), SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()} == digests and set(texts) == kept <= set(docs)
    firsts = {k for k, (_, c) in brute_components(sorted(texts.items()), 5, 80).items() if c == k}
    leaky = {k for k, _ in brute_leaks([(k, texts[k]) for k in firsts], con.execute("SELECT item_id, text FROM benchmark").fetchall(), 5, 0.8)}
    assert {r.doc_id for r in out} == firsts - leaky
    assert all(r.text == texts[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]


def test_stages_on_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and set(docs.columns) <= set(out.columns)
