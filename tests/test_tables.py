"""Text, retrieval, cleaning, upsert and streaming jobs against brute force on small fixtures."""

import datetime
import random
import re
import shutil

import numpy as np
import pytest
from barloom.functions import scalars as sc
from barloom.operators import cleaning, portfolio, retrieval, text
from barloom.sources import readers, stored, upsert
from barloom.streaming import jobs
from pyspark.sql import functions as F


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!", "?", ","]) for _ in range(n))


def pack(parts, size, overlap, glue):
    out, cur, used = [], [], 0
    for p in parts:
        if used + len(p) > size and cur:
            out.append(glue.join(cur))
            kept, k = [], 0
            for q in reversed(cur):
                if overlap and k + len(q) <= overlap:
                    kept, k = [q, *kept], k + len(q)
                else:
                    break
            cur, used = kept, k
        cur, used = [*cur, p], used + len(p)
    return [*out, glue.join(cur)] if cur else out


def sent(t):
    return [s for s in re.split(r"(?<=[.!?])\s+", t) if s]


def collected(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(r["chunk"])
    return out


def test_chunk_sentences_brute_force(spark):
    texts = [prose(i, 80) for i in range(6)] + ["One. Two! Three? " * 5, "x" * 50]
    got = collected(text.chunk_sentences(docs(spark, texts), "text", 60, 20))
    for i, t in enumerate(texts):
        assert got[i] == pack(sent(t), 60, 20, " ")


def test_chunk_paragraphs_brute_force(spark):
    texts = ["\n\n".join(prose(i * 10 + j, random.Random(i + j).randint(2, 40)) for j in range(8)) for i in range(5)]

    def want(t, size):
        out, cur, used = [], [], 0
        for p in (x.strip() for x in re.split(r"\n\s*\n", t)):
            if not p:
                continue
            if len(p) > size:
                out += pack(sent(p), size, 20, " ")
                continue
            if used + len(p) > size and cur:
                out.append("\n\n".join(cur))
                cur, used = [], 0
            cur, used = [*cur, p], used + len(p)
        return [*out, "\n\n".join(cur)] if cur else out

    got = collected(text.chunk_paragraphs(docs(spark, texts), "text", 120, 20))
    for i, t in enumerate(texts):
        assert got[i] == want(t, 120)


def near_brute(items):
    items, late = sorted(items, key=lambda x: (x[2], x[0])), set()
    sets = [(i, t.lower(), set(t.lower().split())) for i, t, _ in items]
    for a in range(len(sets)):
        for b in range(a):
            (_, ta, x), (_, tb, y) = sets[a], sets[b]
            if ta == tb or (len(x) > 3 and len(y) > 3 and len(x & y) > 0.8 * max(len(x), len(y))):
                late.add(sets[a][0])
                break
    return late


def test_near_duplicates_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)]
    items = []
    for i in range(150):
        if items and rng.random() < 0.6:
            ws = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            ws = ws + rng.sample(vocab, rng.randint(0, 2))
        else:
            ws = rng.sample(vocab, rng.choice([2, 3, 4, 6, 9, 12, 15, 17, 20, 24]))
        items.append((f"id{i:03d}", " ".join(ws), datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 20))))
    items += [(f"copy{i:03d}", "the same five words here", datetime.date(2024, 1, 5)) for i in range(80)]
    df = spark.createDataFrame(items, "id string, title string, published date")
    got = {r["id"] for r in retrieval.near_duplicates(df, "id", "title", ["published", "id"]).collect()}
    assert got == near_brute(items)


@pytest.mark.parametrize("block", [(3, 40), (1024, 8192), (1, 1)])
def test_knn_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(7, 8))
    x[50] = x[10]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<double>")
    got = {}
    for r in retrieval.knn(corpus, queries, 4, block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i, v in enumerate(q):
        assert got[f"q{i}"] == np.argsort(((x - v) ** 2).sum(1), kind="stable")[:4].tolist()


def test_knn_copies_rows_by_large_blocks(spark, monkeypatch):
    """A row is copied once per block of at most SPREAD, or of LARGEST rows; the tiles inside a block change no result."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(150, 4)), rng.normal(size=(20, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    monkeypatch.setattr(retrieval, "SPREAD", 2)
    for largest in ((1 << 14, 1 << 15), (5, 50)):
        monkeypatch.setattr(retrieval, "LARGEST", largest)
        near = retrieval._blocked(corpus, queries, 150, "query_id int, id int, distance double", (2, 7))
        assert near.count() == 20 * 150
        got = {}
        for r in retrieval.knn(corpus, queries, 3, (2, 7)).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {i: np.argsort(((x - v) ** 2).sum(1), kind="stable")[:3].tolist() for i, v in enumerate(q)}


def test_knn_ships_numbers_other_than_zero_and_keeps_ties(spark, monkeypatch):
    """Sparse vectors with copies, zero vectors and huge numbers; tiles with few and with many near rows choose the same; odd vectors are near nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 300)) * (rng.random((120, 300)) < 0.05)
    q = np.concatenate([x[:9] + 0.1 * (rng.random((9, 300)) < 0.01), np.zeros((2, 300))])
    x[40:80] = x[3]
    bad = [None, [None] * 300, [float("nan")] * 300]
    corpus = spark.createDataFrame([(f"i{i:03d}", v) for i, v in enumerate([*x.tolist(), *bad])], "id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate([*q.tolist(), *bad])], "query_id int, embedding array<double>")
    packed = {r["id"]: r for r in retrieval._packed(corpus, "id").collect()}
    assert len(packed) == 120 and all(np.array_equal(np.frombuffer(packed[f"i{i:03d}"]["at"], "uint16"), np.flatnonzero(v)) for i, v in enumerate(x))
    assert all(np.array_equal(np.frombuffer(packed[f"i{i:03d}"]["vs"]), v[v != 0]) for i, v in enumerate(x))
    far = ((q[:, None] - x) ** 2).sum(2)
    want = {i: [f"i{j:03d}" for j in sorted(range(120), key=lambda j: (d[j], j))[:5]] for i, d in enumerate(far)}
    for many, largest, scale in ((64, (1 << 18, 1 << 17), 1.0), (0, (4, 50), 1.0), (64, (4, 50), 2.0**60)):
        monkeypatch.setattr(retrieval, "MANY", many)
        monkeypatch.setattr(retrieval, "LARGEST", largest)
        big = [df.withColumn("embedding", F.transform("embedding", lambda v: v * scale)) for df in (corpus, queries)]
        got = {}
        for r in retrieval.knn(*big, 5, (4, 32)).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
            assert np.isclose(r["distance"], far[r["query_id"], int(r["id"][1:])] * scale**2, rtol=1e-9, atol=1e-12 * scale**2)
        assert got == want
    with pytest.raises(Exception, match="different lengths"):
        retrieval.knn(corpus, spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>"), 2).collect()


def test_near_duplicates_of_long_titles(spark):
    """Sets above MAX_SET in groups of copies that differ by a few words, with equal dates and keys, settled by the first met or a later one."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = []
    for group in range(8):
        own = rng.sample(words, rng.randint(14, 60))
        for _ in range(6):
            ws = [w if rng.random() > 0.08 else rng.choice(words) for w in own]
            rng.shuffle(ws)
            items.append((f"k{len(items):03d}", " ".join(ws), datetime.date(2024, 1, rng.randint(1, 4))))
    df = spark.createDataFrame(items, "id string, title string, published date")
    got = {r["id"] for r in retrieval.near_duplicates(df, "id", "title", ["published", "id"]).collect()}
    assert got == near_brute(items) and 5 < len(got) < 48
    sets = retrieval._numbered(spark.createDataFrame([("w:a b c d", 1), ("w:b c d e", 1), ("w:x y z u", 0)], "g string, at int"))
    assert sorted((r["i"], r["d"], r["ws"][0]) for r in sets.collect()) == [(0, 0, "x"), (1, 1, "a"), (2, 1, "b")]


def test_answers_use_the_context(spark):
    day = datetime.date(2024, 1, 1)
    arts = [("a", "Apple results", "AAPL (Apple Inc.) shares rise on strong growth. Revenue was $90 in the quarter.", "wire", day, "l1"),
            ("b", "Market news", "The market index fell and losses mounted. Analysts expect a weak year and a further drop.", "desk", day, "l2"),
            ("c", "Cooking", "A soup needs salt and time to cook well.", "blog", day, "l3")]
    articles = spark.createDataFrame(arts, "id string, title string, content string, source string, published date, link string")
    qs = spark.createDataFrame([(1, "How are AAPL shares doing?"), (2, "where is the market going?"), (3, "tell me about soup")], "query_id int, query string")
    got = {r["query_id"]: r for r in retrieval.answer_questions(articles, qs, 2).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["query_type"], two["query_type"], three["query_type"]) == ("stock_performance", "market_analysis", "general") and len(got) == 3
    assert "AAPL (Apple Inc.)" in one["response"] and "tone is positive" in one["response"] and "Direction: falling" in two["response"]
    assert [q["sources"][0]["source"] for q in (one, two, three)] == ["wire", "desk", "blog"]


def test_tone_is_a_balance_of_words(spark):
    rows = [("up", "Shares rose and profits grew."), ("down", "Shares fell although the group grew; losses widened."), ("none", "The update was put on supper downtown."), ("both", "It rose, then fell.")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k string, c string").select("k", retrieval.balance(F.lower("c"), retrieval.RISING, retrieval.FALLING)).collect()}
    assert got["up"] > 0 > got["down"] and got["none"] == got["both"] == 0


def test_currency_and_caps(spark):
    df = spark.createDataFrame([(1234.56,), (0.0,), (-1234.56,)], "v double")
    assert [r[0] for r in df.select(sc.format_currency("v")).collect()] == ["$1,234.56", "$0.00", "-$1,234.56"]
    t = docs(spark, ["a  b\n c" * 10])
    assert t.select(text.clean_whitespace("text", 10)).first()[0] == "a b ca b c..."
    assert t.select(sc.sanitize_text(F.lit("a|b~c<d>"))).first()[0] == "abc<d>"


def test_smote_makes_classes_equal(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 5 == 0), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(203, 2)))]
    df = spark.createDataFrame(rows, "id int, label int, x double, y double")
    out = cleaning.smote_balance(df, "id", "label", ["x", "y"], block=16).toPandas()
    assert out["label"].value_counts().nunique() == 1 and (out["copy"] == 0).sum() == 203
    small, new = out[(out["copy"] == 0) & (out.label == 1)], out[out["copy"] > 0]
    assert (new.label == 1).all() and new.x.between(small.x.min(), small.x.max()).all()
    again = cleaning.smote_balance(df.repartition(3), "id", "label", ["x", "y"], block=16).toPandas()
    key = ["id", "copy"]
    assert np.allclose(out.sort_values(key)[["x", "y"]], again.sort_values(key)[["x", "y"]])


def test_clean_and_validate(spark):
    df = spark.createDataFrame([(100.0, 1000), (None, 2000), (-10.0, -3000)], "open double, volume bigint")
    got = cleaning.clean_bars(df, ["open", "open"])
    assert got.count() == 2 and got.where("suspect").count() == 1
    news = spark.createDataFrame([("t", "u"), ("", "u"), (None, "u"), ("t", " ")], "title string, url string")
    assert cleaning.clean_news(news).count() == 1


def test_scenarios_by_name(spark):
    w = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "portfolio_id int, symbol int, weight double")
    names = spark.createDataFrame([(1, "Long Bond"), (2, "Tech Equity")], "symbol int, name string")
    got = {r["scenario"]: r for r in portfolio.scenario_stress(w, names).collect()}
    assert abs(got["market_crash"]["portfolio_impact"] + 10) < 1e-9 and abs(got["recession"]["portfolio_impact"] + 7.5) < 1e-9
    assert got["tech_bubble"]["worst_asset"] == 2


def test_scan_rejects_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.scan_files(spark, "/nowhere/file.xyz")


def test_vectors_are_scaled_tf_idf(spark):
    """Every component against counts by hand; empty and repeated texts."""
    import math
    from collections import Counter

    from pyspark.ml.feature import HashingTF

    from barloom.operators import retrieval as rt

    texts = ["Rates rise as rates rose", "prices fall", "", "prices fall", "a b c d e f g h", "Rates FALL"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in rt.vectorize(rt.vectorizer(features=64).fit(df), df).collect()}
    slot = HashingTF(numFeatures=64).indexOf
    counts = [Counter(slot(w) for w in t.lower().split()) for t in texts]
    held = Counter(k for c in counts for k in c)
    for i, c in enumerate(counts):
        want = {k: n * math.log((len(texts) + 1) / (held[k] + 1)) for k, n in c.items()}
        length = math.sqrt(sum(v * v for v in want.values())) or 1.0
        assert len(got[i]) == 64 and all(math.isclose(x, want.get(k, 0.0) / length, abs_tol=1e-12) for k, x in enumerate(got[i]))


def test_alerts_cross_micro_batches(spark, tmp_path):
    folder = str(tmp_path / "feed")
    schema = "symbol string, date date, close double"
    for i, close in enumerate([99.0, 101.0, 109.0, 98.0]):
        spark.createDataFrame([("A", datetime.date(2024, 1, 1 + i), close)], schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.run(jobs.stream_alerts(feed, [("high", "above", 108.0), ("par", "crossing", 100.0)]), "alerts-test", "append")
    assert sorted((str(r["date"]), r["rule"]) for r in out.collect()) == [("2024-01-02", "par"), ("2024-01-03", "high"), ("2024-01-04", "par")]


def test_alerts_go_on_from_the_checkpoint(spark, tmp_path):
    """Volume and indicator rules, a rule of another symbol, an inactive one, late and dateless bars, nulls, a restart."""
    folder, base = str(tmp_path / "feed"), str(tmp_path / "state")
    schema = "symbol string, date date, close double, volume bigint, rsi double"
    rules = [jobs.Rule("busy", "above", 50, "volume"), jobs.Rule("rsi", "crossing", 30.0, "rsi"), jobs.Rule("b", "above", 0.0, symbol="B"), jobs.Rule("off", "above", 0.0, is_active=False)]
    day = lambda i: datetime.date(2024, 1, i)

    def deliver(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def drain():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.run(jobs.stream_alerts(feed, rules), "alerts-test", "append", base=base).collect()
        return sorted((r["symbol"], str(r["date"]), r["rule"] or "", str(r["last_triggered"]), r["late"]) for r in out)

    deliver(("A", day(2), 1.0, 60, 40.0), ("A", day(4), 1.0, 10, 20.0), ("B", day(1), 1.0, 1, None))
    deliver(("A", day(3), 1.0, 99, 90.0), ("A", day(5), 1.0, 70, None), ("A", day(5), 1.0, 80, 1.0))
    first = [("A", "2024-01-02", "busy", "None", False), ("A", "2024-01-03", "", "None", True), ("A", "2024-01-04", "rsi", "None", False), ("A", "2024-01-05", "", "None", True),
             ("A", "2024-01-05", "busy", "2024-01-02", False), ("B", "2024-01-01", "b", "None", False)]
    assert drain() == sorted(first)
    deliver(("A", day(6), 1.0, 51, 10.0), ("A", day(7), 1.0, None, 50.0), ("A", None, 1.0, 99, 1.0), ("B", day(1), 1.0, 99, 1.0))
    second = [("A", "2024-01-06", "busy", "2024-01-05", False), ("A", "2024-01-07", "rsi", "2024-01-04", False), ("A", "None", "", "None", True), ("B", "2024-01-01", "", "None", True)]
    assert drain() == sorted(first + second)
    with pytest.raises(ValueError):
        jobs.stream_alerts(spark.readStream.schema(schema).parquet(folder), [("x", "sideways", 1.0)])


def test_alerts_send_numbers_to_the_tasks(spark, tmp_path):
    """Dates and names stay out of the Python tasks, whose work per row was most of the job."""
    folder = str(tmp_path / "feed")
    schema = "symbol string, date date, close float, note string"
    rows = [("A", datetime.date(1969, 12, 30), 1.0, "x"), ("A", datetime.date(1969, 12, 31), 3.0, "x"), (None, datetime.date(2024, 1, 1), 3.0, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    alerts = jobs.stream_alerts(spark.readStream.schema(schema).parquet(folder), [("up", "crossing", 2.0), ("high", "above", 2.0)])
    plan = alerts._jdf.queryExecution().analyzed().toString()
    sent = next(x for x in plan.splitlines() if "FlatMapGroupsInPandasWithState" in x)
    assert "day#" in sent and "date#" not in sent and "note#" not in sent
    out = sorted((str(r["symbol"]), str(r["date"]), r["rule"], r["field"], r["value"], r["previous"], r["last_triggered"], r["late"]) for r in jobs.run(alerts, "alerts-test", "append").collect())
    assert out == [("A", "1969-12-31", "high", "close", 3.0, 1.0, None, False), ("A", "1969-12-31", "up", "close", 3.0, 1.0, None, False),
                   ("None", "2024-01-01", "high", "close", 3.0, None, None, False)]


def test_stream_bars_merge_batches(spark, tmp_path):
    folder = str(tmp_path / "ticks")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    base = datetime.datetime(2024, 1, 1, 10)
    for i in range(4):
        rows = [(i * 2 + j, base + datetime.timedelta(minutes=10 * i + j), 1, "view", float(10 * i + j), "") for j in range(2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    bars = jobs.stream_bars(jobs.read_ticks(spark, folder, "*.parquet", 1), "60 minutes", "2 hours")
    r = jobs.run(bars, "bars-test", "update", ["symbol", "start"]).collect()
    assert len(r) == 1 and (r[0]["open"], r[0]["high"], r[0]["low"], r[0]["close"], r[0]["volume"]) == (0.0, 31.0, 0.0, 31.0, 8)


def test_streams_read_files_and_folders(spark, tmp_path):
    """A table may be one file, a folder of files, or empty."""
    import __spark_entry__

    news = __spark_entry__.queries()["stream_upsert_news"]
    docs = spark.createDataFrame([(i, f"title {i % 5}\nbody {i % 5}") for i in range(20)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    shutil.copy(next((tmp_path / "parts").glob("*.parquet")), tmp_path / "file" / "documents.parquet")
    found = {k: sorted(r["title"] for r in news(spark, str(tmp_path / k)).collect()) for k in ("folder", "file", "empty")}
    assert found == {"folder": [f"title {i}" for i in range(5)], "file": [f"title {i}" for i in range(5)], "empty": []}


def test_join_unique_with_a_hot_key(spark):
    from barloom.functions.skew import join_unique

    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(30000)]
    big = spark.createDataFrame(rows, "i int, k string")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = join_unique(big, small, "k", "n")
    want = big.join(small.drop("n"), "k")
    assert got.count() == 30000 and got.exceptAll(want.select(*got.columns)).count() == 0


def test_stored_tables_show_whole_commits(spark, tmp_path, monkeypatch):
    path, year = str(tmp_path / "t"), F.col("year")
    stored.create(spark.createDataFrame([(1, 2020, 1.0), (2, 2020, 2.0), (3, 2021, 3.0), (4, None, 4.0)], "k int, year int, v double"), path, year)
    first = stored.commit(spark, path)["partitions"]
    assert set(first) == {"2020", "2021", "null"}
    batch = spark.createDataFrame([(2, 2020, 20.0, "a"), (9, 2022, 9.0, None), (4, None, None, "b")], "k int, year int, v double, note string")

    def rows(version=None):
        return sorted((tuple(r) for r in stored.read(spark, path, version).collect()), key=str)

    # a job that dies between write and commit leaves the table as it was
    with monkeypatch.context() as m:
        m.setattr(stored, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stored.upsert_table(spark, path, batch, ["k", "year"], year, "b1")
    assert rows() == [(1, 2020, 1.0), (2, 2020, 2.0), (3, 2021, 3.0), (4, None, 4.0)] and stored.versions(spark, path) == [0]

    want = [(1, 2020, 1.0, None), (2, 2020, 20.0, "a"), (3, 2021, 3.0, None), (4, None, 4.0, "b"), (9, 2022, 9.0, None)]
    assert stored.upsert_table(spark, path, batch, ["k", "year"], year, "b1") == 1 and rows() == want
    second = stored.commit(spark, path)["partitions"]
    assert second["2021"] == first["2021"] and second["2020"] != first["2020"]  # copy on write
    # the same batch again changes nothing, earlier commits stay readable, partitions can be read alone
    assert stored.upsert_table(spark, path, batch, ["k", "year"], year, "b1") == 1 and rows() == want and len(rows(0)) == 4
    assert [r.k for r in stored.read(spark, path, partitions=["2021"]).collect()] == [3]
    # a writer that another one overtakes starts over on top of it
    publish, raced = stored.publish, []

    def slow(spark_, path_, version, content):
        if not raced:
            raced.append(version)
            stored.upsert_table(spark, path, spark.createDataFrame([(3, 2021, 33.0)], "k int, year int, v double"), ["k", "year"], year, "other")
        publish(spark_, path_, version, content)

    with monkeypatch.context() as m:
        m.setattr(stored, "publish", slow)
        assert stored.upsert_table(spark, path, spark.createDataFrame([(1, 2020, 10.0)], "k int, year int, v double"), ["k", "year"], year, "b2") == 3
    assert {r[0]: r[2] for r in rows()} == {1: 10.0, 2: 20.0, 3: 33.0, 4: 4.0, 9: 9.0}
    with pytest.raises(stored.Conflict):
        stored.publish(spark, path, 3, {})
    assert stored.vacuum(spark, path) >= 4 and stored.versions(spark, path) == [3] and {r[0] for r in rows()} == {1, 2, 3, 4, 9}


def test_upsert_merges_fields(spark):
    stored = spark.createDataFrame([(1, 1.0, "a", 0), (2, 2.0, "b", 0), (None, 3.0, "c", 0)], "k int, v double, name string, kept int")
    incoming = spark.createDataFrame([(1, None, "x", 1), (1, 5.0, None, 2), (1, 4.0, "y", 1), (3, 9.0, None, 1), (None, None, "z", 1)], "k int, v double, name string, updated_at int")
    got = sorted(upsert.upsert(stored, incoming, ["k"]).collect(), key=str)
    assert sorted([(1, 5.0, "y", 0, 2), (2, 2.0, "b", 0, None), (3, 9.0, None, None, 1), (None, 3.0, "z", 0, 1)], key=str) == sorted([tuple(r) for r in got], key=str)
