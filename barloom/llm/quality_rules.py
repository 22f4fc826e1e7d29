"""Quality rules with risk-controlled thresholds.  Column expressions only.

Each rule rejects a document when a ratio of two of its counts exceeds a cutoff.  The cutoffs come from labelled
documents: per stratum the strictest cutoffs of fixed ladders are taken whose false-rejection rate among good documents is
below ``risk`` with confidence, by the exact binomial test.  Error is divided over all strata, and over the rules where
each is tested by itself (Bonferroni); within one ladder the cutoffs are tested from the most lenient to the strictest and
testing stops at the first failure, which needs no further correction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import WORD
from barloom.sources.readers import materialize

#: Ratios in percent: name, numerator, denominator, ladder of cutoffs from lenient to strict.
RULES = [
    ("symbols", "n_symbols", "word_chars", [60, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1]),
    ("repeats", "n_repeat_words", "n_words", [45, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5]),
    ("lines", "n_dup_lines", "n_lines", [90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10]),
    ("long_words", "word_chars", "n_words", [4000, 3000, 2500, 2000, 1800, 1600, 1400, 1200, 1100, 1000, 900]),
]
#: Steps of all ladders in one, as positions in each: word length, which differs between languages, goes last.
TOGETHER = [(i, min(i, 11), min(i, 10), i // 3) for i in range(16)] + [(15, 11, 10, i) for i in range(6, 11)]
BASE_WORDS, BASE_REPEATS = 50, 50
#: Strata up to which their cutoffs (four numbers each) are broadcast.
STRATA = 10_000


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included.

    Windows are sorted with their positions, so that equal ones are neighbours; the positions of those with an equal
    neighbour, in order, cover three words each.  Texts without an equal pair of windows end at the first test.
    """
    def covered(sorted_windows: Column) -> Column:
        again = F.filter(
            F.transform(sorted_windows, lambda w, i: F.struct(
                w["at"].alias("at"),
                (F.get(sorted_windows, i - 1)["w"].eqNullSafe(w["w"]) | F.get(sorted_windows, i + 1)["w"].eqNullSafe(w["w"])).alias("twice"))),
            lambda x: x["twice"])
        at = F.sort_array(F.transform(again, lambda x: x["at"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    def windows(w: Column) -> Column:
        run = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(run, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("w"), i.alias("at")))), covered)))

    return let(words, windows)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines and n_repeat_words of the whole text.

    A null or empty text has none of them.  Existing columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    counts = {
        "n_words": let(words, F.size), "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")), "n_lines": let(lines, F.size),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_repeat_words": repeated_words(words)}
    return docs.withColumns({k: v.cast("long") for k, v in counts.items()})


def log_at_most(k: Column, n: Column, p: float) -> Column:
    """Natural logarithm of P(X <= k) for X ~ Binomial(n, p), for k <= n * p; exact up to rounding.

    The term at k comes from a sum of logarithms; those below it are products of ratios that fall from k down to 0.
    """
    odds = (1 - p) / p
    top = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i))).otherwise(0.0)
    top = top + k * math.log(p) + (n - k) * math.log1p(-p)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, j: let(a["term"] * F.when(k > j, (k - j) / (n - k + j + 1) * odds).otherwise(0.0), lambda x: F.struct((a["sum"] + x).alias("sum"), x.alias("term"))))["sum"]
    return top + F.log(tail)


def exceeds(numerator: str, denominator: str, cutoff: Column | int) -> Column:
    return F.coalesce(100 * F.col(numerator) > cutoff * F.col(denominator), F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))


def cutoffs(labelled: DataFrame, stratum: str, risk: float = 0.02, confidence: float = 0.95, good: str = "good") -> DataFrame:
    """One row per stratum with a cutoff: stratum, pooled, n_good and the cutoff of each rule (null: none).

    ``labelled`` has the counts of ``features`` and a boolean ``good``.  With probability ``confidence`` at least, over the
    draw of the labelled documents, no stratum's rules reject more than ``risk`` of its good documents together.  The
    strata, and a pool, share the error equally:

    * A stratum with labels enough for it tests each rule with an equal share of the risk and of its error.
    * One with fewer makes tests of the whole risk for all rules, in two ladders with half of its error each.  The first
      takes over the cutoffs of the largest stratum above, but for word length, which differs between languages; then
      word length descends.  They come from other documents, so they are fixed as far as this stratum's labels are
      concerned.  If that ladder certifies nothing, all rules descend TOGETHER.
    * Strata below the need of that too are pooled and tested as one more stratum; the bound then holds for the pool's good
      documents together.

    Which tests are made depends on the strata's sizes and on other strata alone.  A stratum without any good document,
    and a pool too small for its tests, have no row.  Counts are sums, so a stratum of any size combines before the
    shuffle.
    """
    share = risk / len(RULES)
    names = [name for name, *_ in RULES]
    n_hits = lambda *tests: F.sum(F.array_contains(F.array(*tests), True).cast("long"))
    chosen = labelled.where(good).withColumn("stratum", F.col(stratum))
    each_ladder = {name: [F.sum(exceeds(a, b, c).cast("long")) for c in ladder] for name, a, b, ladder in RULES}
    together = {"together": [n_hits(*[exceeds(a, b, ladder[i]) for i, (_, a, b, ladder) in zip(at, RULES)]) for at in TOGETHER]}
    counted = [F.count("*").alias("n")] + [k.alias(f"{rule}_{i}") for rule, ks in (each_ladder | together).items() for i, k in enumerate(ks)]
    per = materialize(chosen.groupBy("stratum").agg(*counted), "strata")  # one row per stratum
    allowed = math.log((1 - confidence) / (per.count() + 1))
    each, half = allowed - math.log(len(RULES)), allowed - math.log(2)
    # good documents that a test without a single rejection needs
    need, need_together = math.ceil(each / math.log1p(-share)), math.ceil(half / math.log1p(-risk))
    pooled = F.col("n") < need_together
    member = per.select("stratum", pooled.alias("pooled"), F.when(pooled, "").otherwise(F.col("stratum")).alias("unit"))
    units = per.join(member, "stratum").groupBy("unit", "pooled").agg(*[F.sum(c).alias(c) for c in per.columns[1:]])

    def certified(counts: DataFrame, ladders: dict[str, int], p: float, level: float) -> DataFrame:
        """unit, pooled, n, rule and the last step of each ladder before its first failure."""
        steps = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.col(f"{rule}_{i}").alias("k"))
                                    for rule, size in ladders.items() for i in range(size)]))
        near = F.col("k") <= F.col("n") * p
        passed = F.when(near, log_at_most(F.when(near, F.col("k")).otherwise(F.lit(0).cast("long")), F.col("n"), p) <= level).otherwise(False)
        tested = counts.select("unit", "pooled", "n", steps.alias("s")).select("unit", "pooled", "n", "s.*").withColumn("passed", passed)
        return tested.groupBy("unit", "pooled", "n", "rule").agg(
            (F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.max("step") + 1) - 1).alias("step")).where("step >= 0")

    def value(rule: str, cutoffs_: list) -> Column:
        return F.max(F.when(F.col("rule") == rule, F.get(F.array(*[F.lit(c).cast("int") for c in cutoffs_]), F.col("step"))))

    key = ["unit", "pooled", F.col("n").alias("n_good")]
    wide = certified(units.where(F.col("n") >= need), {name: len(ladder) for name, *_, ladder in RULES}, share, each).groupBy(*key).agg(
        *[value(name, ladder).alias(name) for name, *_, ladder in RULES])
    wide = materialize(wide, "cutoffs_each")
    donor = wide.where("not pooled").orderBy(F.desc("n_good"), "unit").first()
    few, ladders = units.where(F.col("n") < need), {"together": len(TOGETHER)}
    given = [tuple(donor[n] for n in names[:-1]) if donor else (None,) * (len(names) - 1)] * (len(RULES[-1][3]) + 1)
    last = [None, *RULES[-1][3]]
    if donor:
        tests = [n_hits(*[exceeds(a, b, F.lit(c).cast("int")) for c, (_, a, b, _) in zip([*cs, z], RULES)]) for cs, z in zip(given, last)]
        taken = chosen.join(F.broadcast(member) if per.count() <= STRATA else member, "stratum").groupBy("unit", "pooled").agg(
            *[k.alias(f"taken_{i}") for i, k in enumerate(tests)])
        few, ladders = few.join(taken, ["unit", "pooled"]), {"taken": len(tests)} | ladders
    best = certified(few, ladders, risk, half).groupBy(*key).agg(*[
        F.coalesce(F.when(F.max((F.col("rule") == "taken").cast("int")) == 1, F.struct(value("taken", [[*cs, z][r] for cs, z in zip(given, last)]).alias("v"))),
                   F.struct(value("together", [ladder[at[r]] for at in TOGETHER]).alias("v")))["v"].alias(name)
        for r, (name, *_, ladder) in enumerate(RULES)])
    return member.join(wide.unionByName(best), ["unit", "pooled"]).drop("unit")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, confidence: float = 0.95, text: str = "text") -> DataFrame:
    """doc_id, the stratum, the counts of ``features``, base_failed, rejected_by (names of rules) and kept, per row of docs.

    ``labels``: doc_id, quality (1: good); a repeated doc_id counts once, good only if all its labels say so; null labels
    and labels of unknown documents count nowhere.  A null stratum is a stratum of its own.  Repeated rows of ``docs``
    give repeated rows.  Without labels only the base rules reject.
    """
    counted = features(docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text")))
    # seven numbers a document; the texts are read once
    counted = materialize(counted.drop("text").withColumn("base_failed", base_failed()), "rules")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = counted.where(~F.col("base_failed")).join(known, "doc_id")
    wide = cutoffs(labelled, "stratum", risk, confidence).select("stratum", *[F.col(name).alias(f"_{name}") for name, *_ in RULES])
    wide = materialize(wide, "cutoffs")
    if wide.limit(STRATA + 1).count() <= STRATA:  # else both sides are shuffled
        wide = F.broadcast(wide)
    hits = [F.when(exceeds(a, b, F.col(f"_{name}")), F.lit(name)) for name, a, b, _ in RULES]
    judged = counted.join(wide, "stratum", "left").withColumn("rejected_by", F.array_compact(F.array(*hits)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*[f"_{name}" for name, *_ in RULES])


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, confidence: float = 0.95, text: str = "text") -> DataFrame:
    """The rows of ``docs`` of kept documents, with their own columns; rows with one doc_id, or with none,
    stay together if the verdict keeps any of them."""
    verdict = judge(docs, labels, stratum, risk, confidence, text).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["_kept"]), "left_semi")


def sql(risk: float = 0.02, confidence: float = 0.95) -> str:
    """The same for DuckDB, over documents and labels with lang as the stratum."""
    names = [name for name, *_ in RULES]
    tests = {(name, i): f"100 * {a} > {c} * {b}" for name, a, b, cs in RULES for i, c in enumerate(cs)}
    joint = {("together", i): " OR ".join(f"100 * {a} > {cs[k]} * {b}" for k, (_, a, b, cs) in zip(at, RULES)) for i, at in enumerate(TOGETHER)}
    given = " OR ".join(f"coalesce(100 * {a} > d_{name} * {b}, false)" for name, a, b, _ in RULES[:-1])
    joint |= {("taken", i): given + (f" OR 100 * {RULES[-1][1]} > {c} * {RULES[-1][2]}" if c else "") for i, c in enumerate([None, *RULES[-1][3]])}

    def counted(ladders: dict, rows: str) -> str:
        return " UNION ALL ".join(f"SELECT unit, n, '{rule}' AS rule, {i} AS step, count(*) FILTER ({hit}) AS k FROM {rows} GROUP BY ALL"
                                  for (rule, i), hit in ladders.items())

    def certified(ladders: dict, rows: str, p: float, level: str) -> str:
        return f"""SELECT unit, n, rule, max(step) AS step FROM (
    SELECT *, min(CASE WHEN NOT passed THEN step END) OVER (PARTITION BY unit, rule) AS failed FROM (
      SELECT *, k <= n * {p!r} AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i:
                exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) <= exp((SELECT {level} FROM level)) AS passed
      FROM ({counted(ladders, rows)})))
  WHERE failed IS NULL OR step < failed GROUP BY ALL"""

    values = lambda rows: ", ".join(f"({r!r}, {i}, {c})" for r, i, c in rows)
    single = values((name, i, c) for name, *_, cs in RULES for i, c in enumerate(cs))
    both = ", ".join(f"({i}, {', '.join(str(cs[k]) for k, (*_, cs) in zip(at, RULES))})" for i, at in enumerate(TOGETHER))
    lengths = ", ".join(f"({i}, {c or 'NULL::INT'})" for i, c in enumerate([None, *RULES[-1][3]]))
    hits = ", ".join(f"CASE WHEN 100 * {a} > c_{name} * {b} THEN '{name}' END" for name, a, b, _ in RULES)
    c_names = ", ".join(f"c_{name}" for name in names)
    p = risk / len(RULES)
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
pos AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM pos) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM f),
good AS (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
per AS (SELECT stratum, count(*) AS n FROM good GROUP BY ALL),
level AS (SELECT ln((1 - {confidence!r}) / (count(*) + 1)) AS allowed, allowed - ln({len(RULES)}) AS each, allowed - ln(2) AS half,
                 ceil(each / ln(1 - {p!r})) AS need, ceil(half / ln(1 - {risk!r})) AS need_together FROM per),
unit AS (SELECT stratum, coalesce(own, '(pool)') AS unit, sum(n) OVER (PARTITION BY own) AS n, sum(n) OVER (PARTITION BY own) < need AS few
         FROM (SELECT *, CASE WHEN n >= need_together THEN 'own ' || stratum END AS own FROM per, level)),
many AS (SELECT * FROM good JOIN unit USING (stratum) WHERE NOT few),
each_step AS ({certified(tests, 'many', p, 'each')}),
each_cut AS (SELECT unit, n, {', '.join(f"max(cutoff) FILTER (rule = '{name}') AS c_{name}" for name in names)}
             FROM each_step JOIN (VALUES {single}) AS v(rule, step, cutoff) USING (rule, step) GROUP BY ALL),
donor AS (SELECT {', '.join(f'c_{name} AS d_{name}' for name in names)} FROM each_cut WHERE unit <> '(pool)' ORDER BY n DESC, unit LIMIT 1),
sparse AS (SELECT * FROM good JOIN unit USING (stratum) LEFT JOIN donor ON true WHERE few),
joint_step AS ({certified(joint, 'sparse', risk, 'half')}),
taken_cut AS (SELECT unit, {', '.join(f'd_{name}' for name in names[:-1])}, v.cutoff FROM joint_step JOIN (VALUES {lengths}) AS v(step, cutoff) USING (step), donor
              WHERE rule = 'taken'),
joint_cut AS (SELECT unit, v.* EXCLUDE (step) FROM joint_step JOIN (VALUES {both}) AS v(step, {c_names}) USING (step)
              WHERE rule = 'together' AND unit NOT IN (SELECT unit FROM taken_cut)),
cuts AS (SELECT stratum, {c_names} FROM unit JOIN (
           SELECT unit, {c_names} FROM each_cut UNION ALL SELECT * FROM taken_cut UNION ALL SELECT unit, {c_names} FROM joint_cut) USING (unit)),
hit AS (SELECT doc_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS rejected_by FROM b LEFT JOIN cuts USING (stratum))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND len(rejected_by) = 0 AS kept, stratum, rejected_by
FROM b JOIN hit USING (doc_id)"""
