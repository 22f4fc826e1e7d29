"""A language model of mixed context predictors, and the unigram scores it is compared with.

A token has a code of eight bits, a hash of its last letters.  Each bit of the code is predicted from the bits before it in
several contexts: none, the word before, its last letters, the last letters of the two words before.  A context's
prediction is the logit of its counts; the logits are combined by weights that depend on the bit and on how often the
contexts were seen, and the outcome is refined by an adaptive table over (bit, probability).  Both are learned online in
each block of documents and averaged over the blocks.  Within its code a token has its share of the training tokens.

That is the lowest order.  Two orders above it predict the word itself after the word before and after the two words
before: their counts are keyed by the hash of context and word, so what they gather grows with the corpus.  An
order's probability is (count + s * lower order) / (count of its context + s); s depends on how often the context was seen
and is the strength that predicts the training tokens best, each of them left out of the counts.  The probabilities of
all tokens sum to one.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import deltas, distinct_values, in_blocks, squeeze, undeltas, unsqueeze
from barloom.llm.words import ODD, SPACE, Words, mix, words
from barloom.sources.readers import materialize

#: Bits of a code and of a hashed context; contexts; slots of a table chunk; bytes of a block; tokens of a group.
CODE, CONTEXT, CONTEXTS, CHUNK, BLOCK, GROUP = 8, 12, 4, 1 << 16, 6 << 20, 1 << 23
#: Bits of a pair's or triple's hash beyond those of the number of tokens: one in some thousands meets another one.
SPARE = 14
#: Strengths to choose from; levels of a context, by the binary digits of its count.
STRENGTHS, LEVELS = np.array([0.25, 1, 2, 4, 8, 16, 64, 256]), 32
#: Passes over all training documents in which the weights are learned.
PASSES = 1
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0xD1B54A32D192ED03)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Tokens(NamedTuple):
    """Words of each document and then its end."""

    hashes: np.ndarray
    bounds: np.ndarray
    code: np.ndarray
    contexts: np.ndarray  # (CONTEXTS, tokens): hashed contexts
    pairs: np.ndarray  # a word after the word before
    triples: np.ndarray  # a word after the two words before

    def labels(self, bits: int) -> np.ndarray:
        """Words, then pairs and triples by the highest ``bits`` of their hash."""
        cut = np.uint64(64 - bits)
        return np.concatenate([self.hashes, self.pairs >> cut << cut, self.triples >> cut << cut])

    def of(self, docs: np.ndarray) -> Tokens:
        """The tokens of some of the documents."""
        n = np.diff(self.bounds)
        at = np.repeat(docs, n)
        bounds = np.concatenate([[0], np.cumsum(n[docs])])
        return Tokens(self.hashes[at], bounds, self.code[at], self.contexts[:, at], self.pairs[at], self.triples[at])


class Counted(NamedTuple):
    """Training counts at each token: of itself and, by order, of the word after its context and of the context."""

    own: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]

    def without(self, n: np.ndarray | int) -> Counted:
        """Counts of the two orders without ``n`` tokens of the same kind (1: the token itself, where it was counted)."""
        return Counted(self.own, *(tuple(x - n for x in xs) for xs in self[1:]))


def last_letters(w: Words, *sizes: int) -> list[np.ndarray]:
    """Hashes of the last bytes of each word, for each number of bytes."""
    if not len(w.starts):
        return [np.zeros(0, np.uint64) for _ in sizes]
    # a word's end: the next start at most, before the white space in between
    black = np.append(~SPACE[w.data], False)
    end = np.append(w.starts[1:], len(w.data))
    while not (inside := black[end - 1]).all():
        end = end - ~inside
    grown, out = np.zeros(len(end), np.uint64), {}
    for k in range(1, max(sizes) + 1):
        at = end - k
        grown = grown * np.uint64(257) + np.where(at >= w.starts, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[k] = mix(grown + np.uint64(k))
    return [out[n] for n in sizes]


def tokens(column: pa.Array) -> Tokens:
    w = words(column, lower=True)
    w = w._replace(data=LOWER[w.data])
    n_docs = len(w.bounds) - 1
    bounds = w.bounds + np.arange(n_docs + 1)
    last = np.zeros(len(w.hashes) + n_docs, bool)
    last[bounds[1:] - 1] = True

    def put(x: np.ndarray) -> np.ndarray:
        out = np.full(len(last), END)
        out[~last] = x
        return out

    def before(x: np.ndarray, start: np.uint64) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[bounds[:-1]] = start
        return out

    none = np.uint64(0)
    hashes, (three, two) = put(w.hashes), map(put, last_letters(w, 3, 2))
    p2 = before(two, none)
    keys = [before(hashes, none), before(three, none), p2 + mix(before(p2, none))]
    contexts = np.zeros((CONTEXTS, len(hashes)), np.int32)
    for k, key in enumerate(keys, 1):
        contexts[k] = mix(key) & np.uint64((1 << CONTEXT) - 1)
    pairs = mix(before(hashes, END) * ODD + hashes)
    triples = mix(before(pairs, ~END) * ODD + hashes)
    return Tokens(hashes, bounds, (three & np.uint64((1 << CODE) - 1)).astype(np.int32), contexts, pairs, triples)


def training(ids: list) -> np.ndarray:
    """Documents to learn from: crc32 of the id as text, modulo FOLDS, is not HELD_OUT; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT for i in ids], bool)


def bit_counts(leaves: np.ndarray) -> np.ndarray:
    """Counts of each tree node from those of the leaves: node 1 is the root, 2n and 2n + 1 are below n."""
    out = np.zeros((*leaves.shape[:-1], 2 << CODE), np.float32)
    out[..., 1 << CODE:] = leaves
    for depth in range(CODE - 1, -1, -1):
        low = 1 << depth
        out[..., low:2 * low] = out[..., 2 * low:4 * low:2] + out[..., 2 * low + 1:4 * low:2]
    return out


class Mixer:
    """Bit predictions of all contexts, combined by weights that a gate selects, then refined."""

    STEPS, RATE, BATCH, GATES = 33, 0.02, 256, 27

    def __init__(self, tables: np.ndarray):
        self.counts = bit_counts(tables)  # (CONTEXTS, contexts, nodes)
        self.weights = np.full((CODE * self.GATES, CONTEXTS), 1.0 / CONTEXTS, np.float32)
        self.refined = np.tile(squash(np.linspace(-8, 8, self.STEPS)), CODE)
        self.cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def evidence(self, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Per context and node the logit of its parent's counts and how often the parent was seen (0 to 2), without
        ``own`` counts of the token that leads to the node (1 where it was counted)."""
        if own not in self.cached:
            logits = np.zeros_like(self.counts)
            level = np.zeros(self.counts.shape, np.uint8)
            child = np.arange(2, 2 << CODE)
            for k in range(CONTEXTS):
                total = self.counts[k][:, child >> 1] - np.float32(own)
                ones = self.counts[k][:, child | 1] - (own * (child & 1)).astype(np.float32)
                logits[k][:, 2:] = np.log((np.maximum(ones, 0) + np.float32(0.4)) / (np.maximum(total - ones, 0) + np.float32(0.4)))
                level[k][:, 2:] = (total > 3).astype(np.uint8) + (total > 60)
            self.cached[own] = logits, level
        return self.cached[own]

    def inputs(self, contexts: np.ndarray, code: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits per context, cell of the weights (bit and gate) and the bit itself, for all bits of each token."""
        bits = np.arange(CODE)[:, None]
        node = (code | 1 << CODE) >> (CODE - 1 - bits)
        table, level = self.evidence(own)
        logits = np.empty((CONTEXTS, *node.shape), np.float32)
        gate = np.zeros(node.shape, np.int64)
        for k in range(CONTEXTS):
            at = (contexts[k] << (CODE + 1)) + node
            logits[k] = table[k].reshape(-1).take(at)
            if k:
                gate = gate * 3 + level[k].reshape(-1).take(at)
        return logits, gate + bits * self.GATES, node & 1

    def mix(self, logits: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stretched = np.zeros(cell.shape, np.float32)
        for k in range(CONTEXTS):
            stretched += self.weights[:, k].take(cell) * logits[k]
        stretched = np.clip(stretched, -12, 12)
        return squash(stretched), stretched

    def refine(self, p: np.ndarray, stretched: np.ndarray) -> np.ndarray:
        at = np.clip((stretched + 8) * ((self.STEPS - 1) / 16), 0, self.STEPS - 1.001)
        low = at.astype(np.int64)
        part = at - low
        low += np.arange(CODE)[:, None] * self.STEPS
        return 0.5 * p + 0.5 * (self.refined.take(low) * (1 - part) + self.refined.take(low + 1) * part)

    def learn(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over the tokens of training documents, in order, a few hundred at a time.  Returns how many bits each
        cell of the weights and of the table has seen, and the probability each token's code had before it was learned."""
        predicted = np.ones(len(t.code))
        seen, reached = np.zeros(len(self.weights), np.int64), np.zeros(len(self.refined), np.int64)
        first = np.arange(CODE)[:, None] * self.STEPS
        for a in range(0, len(t.code), 1 << 14):
            logits, cell, y = self.inputs(t.contexts[:, a:a + (1 << 14)], t.code[a:a + (1 << 14)], 1)
            seen += np.bincount(cell.ravel(), minlength=len(seen))
            for b in range(0, cell.shape[1], self.BATCH):
                x, g, z = logits[:, :, b:b + self.BATCH], cell[:, b:b + self.BATCH], y[:, b:b + self.BATCH]
                p, stretched = self.mix(x, g)
                predicted[a + b:a + b + self.BATCH] = np.abs(1 - z - p).prod(0)
                step = self.RATE * (z - p)
                for k in range(CONTEXTS):
                    self.weights[:, k] += np.bincount(g.ravel(), (step * x[k]).ravel(), len(seen))
                at = (np.clip(np.rint((stretched + 8) * ((self.STEPS - 1) / 16)), 0, self.STEPS - 1).astype(np.int64) + first).ravel()
                n = np.bincount(at, minlength=len(reached))
                self.refined += 0.005 * (np.bincount(at, z.ravel(), len(reached)) - n * self.refined)
                reached += n
        self.refined = np.clip(self.refined, 1e-5, 1 - 1e-5)
        return seen, reached, predicted

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 of each token's code in its contexts."""
        out = np.zeros(len(t.code))
        for a in range(0, len(out), 1 << 16):
            logits, cell, y = self.inputs(t.contexts[:, a:a + (1 << 16)], t.code[a:a + (1 << 16)], 0)
            p = self.refine(*self.mix(logits, cell))
            out[a:a + (1 << 16)] = np.log10(np.where(y == 1, p, 1 - p)).sum(0)
        return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def levels(n: np.ndarray) -> np.ndarray:
    """Binary digits of a count: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.frexp(n)[1], LEVELS - 1)


def raised(lower: np.ndarray, c: Counted, strengths: np.ndarray) -> np.ndarray:
    """Probabilities of the highest order from those of the lowest."""
    for k in range(2):
        s = strengths[k][levels(c.contexts[k])]
        lower = (c.words[k] + s * lower) / (c.contexts[k] + s)
    return lower


def likelihoods(lower: np.ndarray, c: Counted) -> np.ndarray:
    """(order, level, strength): sum of the log probabilities of training tokens, each left out of the counts given.  The
    second order stands on the strengths that are best for the first one here."""
    out = np.zeros((2, LEVELS, len(STRENGTHS)))
    for k in range(2):
        at = np.flatnonzero(c.contexts[k])  # without evidence every strength gives the lower order
        words, contexts, under = c.words[k][at], c.contexts[k][at], lower[at]
        level = levels(contexts)
        for j, s in enumerate(STRENGTHS):
            out[k, :, j] = np.bincount(level, np.log((words + s * under) / (contexts + s)), LEVELS)
        s = STRENGTHS[out[k].argmax(1)][level]
        lower = lower.copy()
        lower[at] = (words + s * under) / (contexts + s)
    return out


class Model(NamedTuple):
    mixer: Mixer
    strengths: np.ndarray  # (order, level)
    total: int  # training tokens
    distinct: int
    code_total: np.ndarray  # training tokens of each code
    code_distinct: np.ndarray

    def share(self, t: Tokens, own: np.ndarray) -> np.ndarray:
        """A token's share of the training tokens of its code."""
        return (own + 0.5) / (self.code_total + 0.5 * self.code_distinct + (self.code_distinct == 0))[t.code]


def groups_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes, so that sorted hashes are sorted by group."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Words are lower-cased (A-Z); every document ends with one more token, so a null or empty text has one.  base_score
    sums log10((c + 0.5) / (N + 0.5 (V + 1))) with counts of the training documents; score is the model's log10
    probability of the same tokens, with the unknown ones at the base rate; a training document's token is left out of the
    counts of the two word orders, as it would else predict itself.  Repeated rows count each time.  Counts, tables, weights,
    strengths and both scores cover all whole texts.  Without training documents score and base_score agree.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_groups = max(1, -(-int(size) // BLOCK)), max(1, -(-int(size) // (2 * GROUP)))
    blocked = in_blocks(docs, n_blocks)
    bits = min(64, int(size).bit_length() + SPARE)
    chunks = (CONTEXTS << (CONTEXT + CODE)) // CHUNK
    fan = int(np.ceil(np.sqrt(n_blocks)))  # a chunk's tables are added in two rounds of about as many each

    def emit(table: pa.Table) -> pa.Table:
        """Distinct labels of a block with training counts by group (and codes, of tokens), counts of contexts by chunk."""
        t = tokens(table["text"])
        learn = np.repeat(training(table["doc_id"].to_pylist()), np.diff(t.bounds))
        known, first, which = distinct_values(t.labels(bits))
        counts = np.bincount(which[np.tile(learn, 3)], minlength=len(known)).astype(np.uint32)
        codes = np.append(t.code, 1 << CODE)[np.minimum(first, len(t.code))].astype(np.uint16)
        group = groups_of(known, n_groups)
        block = table["block"][0].as_py()
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(known)]
        rows = [(int(group[a]), block, b - a, squeeze(deltas(known[a:b])), squeeze(counts[a:b]), squeeze(codes[a:b])) for a, b in zip(cuts, cuts[1:])]
        code = t.code[learn]
        for k in range(CONTEXTS):
            full = np.bincount(t.contexts[k][learn] << CODE | code, minlength=1 << (CONTEXT + CODE)).astype(np.uint64)
            for c, part in enumerate(full.reshape(-1, CHUNK), k * (chunks // CONTEXTS)):
                if part.any():
                    rows.append((-1 - c - chunks * (block % fan), -1, CHUNK, b"", squeeze(part), b""))
        return packed(rows)

    def add_tables(table: pa.Table) -> pa.Table:
        """Sum of the tables of one chunk."""
        total = np.zeros(CHUNK, np.uint64)
        for data in table["counts"].to_pylist():
            total += unsqueeze(data, CHUNK, np.uint64)
        return packed([(table["grp"][0].as_py(), -1, CHUNK, b"", squeeze(total), b"")])

    def add(table: pa.Table) -> pa.Table:
        """Sums of one group, sent back to each block in its own order; sums of a chunk of some blocks as they are."""
        group, sizes = table["grp"][0].as_py(), table["n"].to_pylist()
        if group < 0:
            return add_tables(table)
        labels = [undeltas(unsqueeze(d, n, np.uint64)) for d, n in zip(table["labels"].to_pylist(), sizes)]
        counts = np.concatenate([unsqueeze(d, n, np.uint32) for d, n in zip(table["counts"].to_pylist(), sizes)])
        codes = np.concatenate([unsqueeze(d, n, np.uint16) for d, n in zip(table["codes"].to_pylist(), sizes)])
        known, first, which = distinct_values(np.concatenate(labels))
        total = np.bincount(which, weights=counts, minlength=len(known)).astype(np.uint64)
        distinct = np.bincount(codes[first][total > 0], minlength=(1 << CODE) + 1)[:1 << CODE].astype(np.int64).tobytes()
        answers = np.split(total[which], np.cumsum(sizes)[:-1])
        return packed([(group, b, n, b"", squeeze(x), distinct if i == 0 else None) for i, (b, n, x) in enumerate(zip(table["block"].to_pylist(), sizes, answers))])

    def packed(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["grp", "block", "n", "labels", "counts", "codes"])

    kinds = "grp bigint, block bigint, n bigint, labels binary, counts binary, codes binary"
    sums = blocked.groupBy("block").applyInArrow(emit, kinds).groupBy("grp").applyInArrow(add, kinds)
    sums = materialize(sums.drop("labels"), "tokens")
    tables = sums.where("grp < 0").withColumn("grp", F.pmod(-1 - F.col("grp"), F.lit(chunks))).withColumn("labels", F.lit(b""))
    tables = tables.select("grp", "block", "n", "labels", "counts", "codes").groupBy("grp").applyInArrow(add_tables, kinds)
    back = sums.where("grp >= 0").select("block", "grp", "counts")

    def counted(t: Tokens, mine: pa.Table, learn: np.ndarray | None = None) -> Counted:
        """The counts that were sent back, at each token of the block or of those documents of it."""
        known, _, which = distinct_values(t.labels(bits))
        group = groups_of(known, n_groups)
        counts = np.zeros(len(known), np.float64)
        for g, data in zip(mine["grp"].to_pylist(), mine["counts"].to_pylist()):
            a, b = np.searchsorted(group, [g, g + 1])
            counts[a:b] = unsqueeze(data, b - a, np.uint64)
        own, pairs, triples = counts[which].reshape(3, -1)
        first, last = t.bounds[:-1], t.bounds[1:] - 1
        after_word, after_pair = (np.concatenate([x[:1], x[:-1]]) for x in (own, pairs))
        after_word[first] = after_pair[first] = own[last]  # a document follows an end
        if learn is None:
            return Counted(own, (pairs, triples), (after_word, after_pair))
        at = np.repeat(learn, np.diff(t.bounds))
        return Counted(own[at], (pairs[at], triples[at]), (after_word[at], after_pair[at]))

    model = docs.sparkSession.sparkContext.broadcast(fit(blocked, back, tables, sums, counted))

    def apply(table: pa.Table, mine: pa.Table) -> pa.Table:
        m = model.value
        ids = table["doc_id"].to_pylist()
        t = tokens(table["text"])
        c = counted(t, mine)
        everything = m.total + 0.5 * (m.distinct + 1)
        base = np.log10((c.own + 0.5) / everything)
        unknown = 0.5 / everything
        if m.total:
            c = c.without(np.repeat(training(ids), np.diff(t.bounds)).astype(np.float64))
            lowest = m.share(t, c.own) * 10 ** m.mixer.log10(t)
            model_score = np.where(c.own > 0, np.log10(raised(lowest, c, m.strengths) * (1 - unknown)), np.log10(unknown))
        else:
            model_score = base
        at = t.bounds[:-1]
        size = pc.binary_length(table["text"]).to_numpy()
        scores = np.add.reduceat(model_score, at)
        return pa.table([
            table["doc_id"].cast(pa.int64()), pa.array(~training(ids)), pa.array(np.diff(t.bounds)), pa.array(np.add.reduceat((c.own > 0).astype(np.int64), at)),
            pa.array(np.full(len(ids), m.total, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(scores), pa.array(-scores / np.log10(2) / np.maximum(size, 1))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        apply, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


def fit(blocked: DataFrame, back: DataFrame, chunks: DataFrame, sums: DataFrame, counted: Callable) -> Model:
    """The model: tables of the bit predictors (CONTEXTS x 2^CONTEXT x 2^CODE counts), weights and strengths learned from all
    training documents.  The counts of words after their contexts stay in ``back``."""
    tables = np.zeros(((CONTEXTS << (CONTEXT + CODE)) // CHUNK, CHUNK), np.uint64)
    for row in chunks.select("grp", "counts").collect():  # a row per chunk
        tables[row.grp] = unsqueeze(row.counts, CHUNK, np.uint64)
    tables = tables.reshape(CONTEXTS, 1 << CONTEXT, 1 << CODE)
    parts = sums.where("grp >= 0 and codes is not null").select("codes")

    def per_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CODE, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << CODE)), pa.array(total)], ["code", "n"])

    distinct = np.zeros(1 << CODE, np.int64)
    for row in parts.mapInArrow(per_code, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():  # one row per code
        distinct[row.code] = row.n
    order0 = tables[0, 0].astype(np.int64)
    model = Model(Mixer(tables), np.ones((2, LEVELS)), int(order0.sum()), int(distinct.sum()), order0, distinct)
    for _ in range(PASSES):
        average(blocked, back, model, counted)
    return model


def average(blocked: DataFrame, back: DataFrame, model: Model, counted: Callable) -> None:
    """One pass over all training documents.  Every block learns from the mixer as it is; a cell of the weights or of the
    table becomes the blocks' mean, weighted by the bits that reached it.  Strengths are the likeliest over all blocks."""
    sent = blocked.sparkSession.sparkContext.broadcast(model)

    def learn(table: pa.Table, mine: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ours = training(table["doc_id"].to_pylist())
        t = tokens(table["text"])
        c = counted(t, mine, ours)
        t = t.of(ours)
        own = copy.copy(sent.value.mixer)
        own.weights, own.refined = own.weights.copy(), own.refined.copy()
        seen, reached, predicted = own.learn(t)
        fits = likelihoods(sent.value.share(t, c.own - 1) * predicted, c.without(1)).reshape(-1, 1)
        widen = lambda x: np.pad(x, ((0, 0), (0, CONTEXTS - 1)))
        values = np.concatenate([own.weights, widen(own.refined[:, None]), widen(fits)]).astype(np.float64)
        n = np.concatenate([seen, reached, (fits[:, 0] != 0).astype(np.int64)])
        cell = np.flatnonzero(n)
        return pa.table([pa.array(cell), pa.array(n[cell]), *[pa.array(v) for v in (values[cell] * n[cell, None]).T]], names=names)

    names = ["cell", "n", *[f"v{k}" for k in range(CONTEXTS)]]
    kinds = ["cell bigint", "n bigint", *[f"v{k} double" for k in range(CONTEXTS)]]
    learned = blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(learn, ", ".join(kinds))
    mixer, fits = model.mixer, np.zeros(2 * LEVELS * len(STRENGTHS))
    n_weights, n_cells = len(mixer.weights), len(mixer.weights) + len(mixer.refined)
    # a row per cell: CODE * (GATES + STEPS) + 2 * LEVELS * STRENGTHS at most
    for row in learned.groupBy("cell").agg(*[F.sum(x).alias(x) for x in names[1:]]).collect():
        if row.cell >= n_cells:
            fits[row.cell - n_cells] = row.v0
        elif row.cell < n_weights:
            mixer.weights[row.cell] = np.array(row[2:]) / row.n
        else:
            mixer.refined[row.cell - n_weights] = row.v0 / row.n
    model.strengths[:] = STRENGTHS[fits.reshape(2, LEVELS, -1).argmax(2)]
    sent.unpersist()
