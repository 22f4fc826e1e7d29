import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from barloom.llm import components, decontamination, jaccard_join, line_dedup, substring_dedup
from barloom.llm.blocks import in_blocks
from barloom.llm.words import WORD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def edited(rng, words, changes, names):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(names)
    return words


def corpus(seed):
    """Unrelated texts, exact copies, chains of small changes, shared passages and odd rows."""
    rng, names = random.Random(seed), vocabulary(seed)
    texts = [" ".join(rng.choices(names, k=rng.choice([1, 2, 3, 12, 13, 14, 40, 120]))) for _ in range(40)]
    passage = " ".join(rng.choices(names, k=30))
    texts += [f"{a} {passage}\n{b}" for a, b in zip(texts[:8], texts[8:16])]
    base = rng.choices(names, k=150)
    for _ in range(40):
        base = edited(rng, base, rng.randint(0, 3), names)
        texts.append(" ".join(base))
    texts += texts[5:15] + [None, "", " \t\n", "A b", "a B", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingle_set(text, size):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = {k: shingle_set(t, size) for k, t in rows}
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("size,percent,limit", [(3, 90, 1 << 21), (5, 80, 1 << 21), (3, 60, 900)])
def test_jaccard_components(spark, documents, size, percent, limit):
    rows = corpus(size)
    got = jaccard_join.join(documents(rows), size, percent, limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, percent) and len(got) == len(rows)


def test_jaccard_odd_rows(spark, documents):
    text = "one two three four five"
    rows = [(7, text), (7, text), (None, text), (None, None), (9, None), (3, "lone words here")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.join(documents(rows)).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None), (9, 9), (3, 3)], key=str)
    assert jaccard_join.join(documents(rows).limit(0)).count() == 0
    kept = jaccard_join.first_of_each(documents([(1, text), (2, text), (3, None), (None, "other")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"] and "n_words" in kept.columns


def test_rows_are_judged_one_by_one(spark, documents):
    """Texts of one doc_id, texts without an id and repeated rows."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a + " more"
    kept = jaccard_join.first_of_each(documents([(1, a), (5, a), (5, b), (8, near)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b)]
    kept = jaccard_join.first_of_each(documents([(None, a), (None, near), (3, near + " still"), (None, b), (None, b), (None, "x y"), (None, None), (None, None), (8, near), (8, near)]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, near + " still"), (None, b), (None, "x y"), (None, None), (None, None)], key=str)
    # two texts that only a text without an id connects
    words = [f"w{i}" for i in range(120)]
    one, middle, two = " ".join(words), " ".join(words[:-5] + ["q"] * 5), " ".join(words[:-5] + ["r"] * 5)
    got = jaccard_join.join(documents([(7, " ".join(words[:-9] + ["q"] * 9)), (None, middle), (3, one), (4, two)]), 3, 92)
    assert [r.component_id for r in got.collect() if r.doc_id in (3, None)] == [3, 3]


@pytest.mark.parametrize("seed,percent,limit,shrink", [(1, 80, 2000, 0.7), (4, 90, 300, 9)])
def test_regions_above_the_limit(spark, documents, monkeypatch, seed, percent, limit, shrink):
    """One passage that all texts hold, chains of copies and a crowd of near copies, cut in rounds and in parts."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 2)
    monkeypatch.setattr(jaccard_join, "SHRINK", shrink)
    rng, names = random.Random(seed), vocabulary(seed, 3000)
    passage = rng.choices(names, k=25)
    rows, base = [], rng.choices(names, k=60)
    for _ in range(60):
        rows.append(" ".join(edited(rng, base, rng.randint(0, 5), names)))
    for _ in range(60):
        rows.append(" ".join(passage + rng.choices(names, k=rng.randint(0, 12))))
    for _ in range(30):
        base = edited(rng, base, 2, names)
        rows.append(" ".join(base))
    rows = list(enumerate(rows))
    got = jaccard_join.join(documents(rows), 3, percent, limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_histograms_rule_out_no_link(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64))
        sets += [base, np.unique(np.concatenate([base[int(rng.integers(0, len(base) // 4 + 1)):], rng.integers(0, 1 << 63, 3).astype(np.uint64)]))]
    sets += [np.unique(rng.integers(0, 1 << 63, int(rng.integers(100, 300))).astype(np.uint64)) for _ in range(20)]
    alive = jaccard_join.possible(np.array([len(x) for x in sets]), [jaccard_join.histogram(x) for x in sets], percent)
    linked = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            linked |= {i, j}
    assert linked <= set(np.flatnonzero(alive).tolist()) and len(linked) > 10 and alive.sum() < len(sets)
    assert jaccard_join.histogram(np.arange(0, 256 * 300, 256, dtype=np.uint64)) == b""


def test_runs_join_over_batches():
    import pyarrow as pa

    def batch(*keys):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["k"])

    found = list(jaccard_join.runs(iter([batch(1, 1), batch(), batch(1, 2), batch(3), batch(3, 3, 4)])))
    assert [t["k"].to_pylist() for t in found] == [[1, 1, 1], [2], [3, 3, 3], [4]]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_pivot(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 3, 1 << jaccard_join.SLOTS)
    met = 0
    for _ in range(400):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = rng.integers(0, max(1, len(a) * (100 - percent) // 100) + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            met += 1
            assert np.intersect1d(jaccard_join.rarest(a, counts, percent), jaccard_join.rarest(b, counts, percent)).size
    assert met > 50


@pytest.mark.parametrize("seed,changes", [(1, 1), (2, 6), (3, 30)])
def test_region_solver_finds_the_components(seed, changes):
    rng = random.Random(seed)
    sets, base = [], list(range(100))
    for k in range(150):
        own = [x if rng.random() > changes / 100 else rng.randrange(10_000) for x in base]
        if k % 40 == 39:
            base = [x + 1000 * k if rng.random() < 0.3 else x for x in base]
        sets.append(np.unique(np.array(own, np.uint64)))
    region = jaccard_join.Region(sets, 80)
    region.solve(np.arange(len(sets)), 0.2)
    wanted = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = wanted[i], wanted[j]
            wanted = [min(a, b) if w in (a, b) else w for w in wanted]
    roots = [region.find(i) for i in range(len(sets))]
    assert len(set(zip(roots, wanted))) == len(set(roots)) == len(set(wanted))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 130)} | {201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_passages(rows, width):
    first = {}
    for k, t in rows:
        w = re.findall(WORD, t or "")
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            first[g] = min(first.get(g, k), k)
    for k, t in rows:
        w = re.findall(WORD, t or "")
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < k for j in range(i, i + width)}
        yield k, (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("width,block,group", [(13, 1 << 20, 1 << 20), (13, 300, 60), (4, 200, 50), (1, 500, 400)])
def test_passages(spark, documents, width, block, group):
    rows = corpus(width) + [(900, "a " * 70), (901, "b " + "a " * 60)]
    got = substring_dedup.remove(documents(rows), width, block, group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(brute_passages(rows, width)) and len(got) == len(rows)


def test_passages_of_odd_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.remove(documents([(4, text), (4, text), (None, text), (None, "x"), (5, text + " end")])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept) for r in got) == sorted(
        [("4", 0, text), ("4", 0, text), ("None", 20, ""), ("None", 0, "x"), ("5", 20, "end")])
    assert substring_dedup.remove(documents([(1, "x")]).limit(0)).count() == 0


def test_layout_divides_heavy_slots_and_joins_light_ones():
    counts = np.zeros(substring_dedup.SLOTS, np.int64)
    counts[[3, 4, 9]] = [5, 4, 95]
    plan = substring_dedup.layout(counts, 10)
    assert plan.first[3] == plan.first[4] != plan.first[9] and plan.parts[9] == 10
    heavy = set(plan.groups(np.full(1000, 9), np.arange(1000, dtype=np.uint64)).tolist())
    assert len(heavy) == 10 and plan.first[3] not in heavy and plan.first[10] not in heavy


def test_lines_of_many_sites(spark, documents):
    common, rare = "Accept all cookies now please", "Seen on two sites only"
    rows = [(i, f"{common} \nown line number {i}\n{'' if i % 2 else rare}\nok", "en", f"s{i % 4 if i < 8 else i}") for i in range(12)]
    rows += [(50, None, "en", "s1"), (51, "", "en", None), (52, f"  {common}", "en", None), (None, common, "en", "q"), (52, f"  {common}", "en", None)]
    got = line_dedup.remove(documents(rows), sites=5)
    assert {"n_words", "n_lines", "n_removed", "source"} <= set(got.columns)
    texts = sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str)
    want = []
    spread = len({r[3] for r in rows if r[1] and rare in r[1]})
    for k, t, _, _ in rows:
        lines = t.split("\n") if t is not None else None
        keep = None if t is None else [x for x in lines if not (x.strip() == common and k != 0) and not (spread >= 5 and x == rare and k != 0)]
        want.append((k, None if keep is None else "\n".join(keep), 0 if keep is None else len(lines) - len(keep)))
    assert texts == sorted(want, key=str)
    assert line_dedup.remove(documents(rows).limit(0)).count() == 0


def test_near_threshold_counts_are_exact(spark):
    """Sketches of 16 registers are far off; the exact second count decides."""
    rows = [(h, h, s, s) for h in range(40) for s in range(h + 1)]
    lines = spark.createDataFrame(rows, "h1 long, h2 long, site long, doc_id long")
    found = {r.h1 for r in line_dedup.spread(lines, sites=10, sketch=12).collect()}
    assert found == set(range(9, 40))


def brute_leaks(rows, items, size, similarity):
    from collections import Counter

    out = {}
    for k, t in rows:
        w = re.findall(WORD, (t or "").translate(LOWER))
        for m, x in items:
            v = re.findall(WORD, (x or "").translate(LOWER))
            if not v:
                continue
            n = min(size, len(v))
            bag = Counter(tuple(v[i:i + n]) for i in range(len(v) - n + 1))
            best = 0
            for a in range(max(1, len(w) - len(v) + 1)):
                window = Counter(tuple(w[a + i:a + i + n]) for i in range(min(len(v), len(w)) - n + 1))
                best = max(best, sum((bag & window).values()) / sum((bag | window).values()))
            if best >= similarity:
                out[k, m] = best
    return out


def test_leaks(spark, documents):
    rng, names = random.Random(3), vocabulary(3)
    items = [(i, " ".join(rng.choices(names, k=k))) for i, k in enumerate([3, 5, 20, 20, 45, 60, 5])] + [(90, None), (91, ""), (92, "Only")]
    rows = corpus(5)
    for i, x in items[:7]:
        rows.append((1000 + i, f"some words {x.upper()} and more"))
        rows.append((3000 + i, " ".join(x.split()[:-1])))  # the item without its last word
        rows.append((4000 + i, " ".join(x.split()[:len(x.split()) * 2 // 3])))
        rows.append((2000 + i, " ".join(rng.choices(names, k=9)) + "\n" + " ".join(edited(rng, x.split(), 1, names))))
    got = decontamination.leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(rows, items, 5, 0.8)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want) > 6
    clean = decontamination.clean_documents(documents([*rows, (None, "ok ok"), (None, None), (None, items[4][1]), (1004, "another text of that id")]), spark.createDataFrame(items, "item_id long, text string"))
    clean = clean.collect()
    assert {r.doc_id for r in clean} == {k for k, _ in rows} - {k for k, _ in want} | {None, 1004} and (3004, 4) in want
    assert sorted(str(r.text) for r in clean if r.doc_id in (None, 1004)) == ["None", "another text of that id", "ok ok"]


def test_leaks_in_parts_and_empty_tables(spark, documents, monkeypatch):
    items = [(i, " ".join(f"item{i}word{k}" for k in range(12))) for i in range(9)]
    rows = [(i, f"x {t} y") for i, t in items]
    monkeypatch.setattr(decontamination, "ITEMS", 150)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(documents(rows), bench).collect()) == [(i, i) for i in range(9)]
    assert decontamination.leaks(documents(rows), bench.limit(0)).count() == 0
    assert decontamination.leaks(documents(rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 15, 20])
def test_hamming_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    queries = prints[rng.integers(0, 200, 300)]
    for _ in range(radius):
        queries = queries ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in decontamination.HammingIndex(prints, radius).near(queries))))
    assert got == {(i, j) for i in range(300) for j in range(200) if bin(int(queries[i] ^ prints[j])).count("1") <= radius}


def test_kept_words_have_the_digest_of_the_contract(spark, documents):
    from barloom.llm.queries import QUERIES

    got = QUERIES["op3_substring_dedup"](spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept) in brute_passages(rows, 13)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want


def test_short_texts_are_spread_over_blocks(spark, documents, monkeypatch):
    """Texts shorter than a passage add no suffix, yet no block may hold all of them."""
    made = []
    monkeypatch.setattr(substring_dedup, "in_blocks", lambda docs, n: made.append(n) or in_blocks(docs, n))
    for rows, least in (([(i, f"a b {i}") for i in range(200)], 12), ([(i, "x" * 1000) for i in range(20)], 156)):
        got = substring_dedup.remove(documents(rows), block=16).collect()
        assert {r.doc_id: (r.kept, r.n_removed) for r in got} == {i: (t, 0) for i, t in rows}
        assert made.pop() >= least
