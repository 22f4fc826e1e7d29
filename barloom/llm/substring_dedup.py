"""Repeated word passages, by suffix trees partitioned by prefix.

A suffix starts at every word that has ``width`` words of its document ahead, itself included.  Suffixes are split by the
words they start with into groups that fit into a task's memory: by their first two words, and where too many suffixes
share those, by all ``width`` words.  In a group the suffixes are sorted by their first ``width`` words; a run of equal
ones is an internal node of the group's suffix tree at that depth, and the documents below it share a passage of at
least that length.  Runs that continue at the next word make up a maximal repeat, whose words are all covered.

Words and prefixes are compared by 64-bit hashes; the prefix group adds further bits (see README).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import deltas, doc_ids, in_blocks, squeeze, undeltas, unsqueeze
from barloom.llm.words import bounded, inside, mix, shingles, words

#: Words of a passage; suffixes of a block and of a prefix group; slots for prefixes of two words; bytes of a block for each
#: of its suffixes.
WIDTH, BLOCK, GROUP, SLOTS, BYTES = 13, 1 << 20, 1 << 20, 1 << 16, 8


class Layout(NamedTuple):
    """Which group a prefix belongs to: the slot's first group and the number of groups it is divided into."""

    first: np.ndarray
    parts: np.ndarray

    def groups(self, slot: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return self.first[slot] + (mix(whole) % self.parts[slot].astype(np.uint64)).astype(np.int64)


def layout(counts: np.ndarray, group: int = GROUP) -> Layout:
    """Neighbouring light slots share a group; a heavy slot is divided by the whole prefix."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at = filled = 0
    for slot, n in enumerate(counts.tolist()):
        if n > group:
            at += filled > 0
            first[slot], parts[slot] = at, -(-n // group)
            at, filled = at + int(parts[slot]), 0
            continue
        if filled and filled + n > group:
            at, filled = at + 1, 0
        first[slot] = at
        filled += n
    return Layout(first, parts)


def slots(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Slot of the first two words (of one word where passages have one) of each suffix."""
    short = shingles(hashes, min(2, width))[at]
    return (short >> np.uint64(48)).astype(np.int64)


def prefix_counts(docs: DataFrame, width: int = WIDTH, text: str = "text") -> np.ndarray:
    """Suffixes per slot, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in bounded(batches, 1 << 22):
            w = words(batch.column(0))
            at = np.flatnonzero(inside(w.bounds, width))
            if len(at):
                total += np.bincount(slots(w.hashes, at, width), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS rows
    counts = np.zeros(SLOTS, np.int64)
    for row in rows:
        counts[row.slot] = row.n
    return counts


class Suffixes(NamedTuple):
    """The suffixes of a block, sorted by group, prefix and document."""

    doc: np.ndarray  # row in the block
    at: np.ndarray  # word in the block
    label: np.ndarray  # hash of the prefix
    group: np.ndarray
    leads: np.ndarray  # where a run of equal prefixes starts; its document has the least id of the run
    run: np.ndarray  # the run of each suffix


def suffixes(hashes: np.ndarray, bounds: np.ndarray, ids: np.ndarray, plan: Layout, width: int) -> Suffixes:
    at = np.flatnonzero(inside(bounds, width))
    label = shingles(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    group = plan.groups(slots(hashes, at, width), label) if len(at) else at
    doc = np.searchsorted(bounds, at, "right") - 1
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((rank[doc], label, group))
    doc, at, label, group = doc[order], at[order], label[order], group[order]
    new = np.ones(len(at), bool)
    new[1:] = (label[1:] != label[:-1]) | (group[1:] != group[:-1])
    return Suffixes(doc, at, label, group, np.flatnonzero(new), np.cumsum(new) - 1)


def remove(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, group: int = GROUP, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and ``kept``, the words outside every passage of ``width`` words that
    also starts in a document with a smaller doc_id, joined by one space.

    Passages are judged on the whole input.  Null and empty texts have no words; texts shorter than ``width`` words stay
    whole.  A null doc_id counts as larger than any other, and rows with equal ids take nothing from each other.  Other
    columns are not carried over.  Copies within a block leave it as one suffix, so a passage that every document holds
    is one entry per block in its group.
    """
    counts = prefix_counts(docs, width, text)
    plan = layout(counts, group)
    # documents shorter than a passage have no suffix, so rows and bytes bound a block too
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    n_blocks = max(1, -(-max(int(counts.sum()), rows, int(size or 0) // BYTES) // block))
    blocked = in_blocks(docs.select("doc_id", F.col(text).alias("text")), n_blocks)

    def emit(table: pa.Table) -> pa.Table:
        ids = doc_ids(table["doc_id"])
        w = words(table["text"])
        s = suffixes(w.hashes, w.bounds, ids, plan, width)
        lead_group = s.group[s.leads]
        cuts = [*np.flatnonzero(np.diff(lead_group, prepend=-1)).tolist(), len(s.leads)]
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            lead = s.leads[a:b]
            known, which = np.unique(ids[s.doc[lead]], return_inverse=True)
            rows.append((int(lead_group[a]), table["block"][0].as_py(), b - a, squeeze(deltas(s.label[lead])), len(known), squeeze(deltas(known)), squeeze(which.astype(np.uint32))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "block", "n", "labels", "n_docs", "docs", "which"])

    def find(table: pa.Table) -> pa.Table:
        """The subtree of one prefix group."""
        sizes = table["n"].to_numpy()
        labels = np.concatenate([undeltas(unsqueeze(d, n, np.uint64)) for d, n in zip(table["labels"].to_pylist(), sizes.tolist())])
        ids = np.concatenate([undeltas(unsqueeze(d, k, np.int64))[unsqueeze(i, n, np.uint32)] for d, k, i, n in zip(
            table["docs"].to_pylist(), table["n_docs"].to_pylist(), table["which"].to_pylist(), sizes.tolist())])
        order = np.argsort(labels, kind="stable")
        ordered = labels[order]
        node = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[order], node), np.diff(np.append(node, len(order))))
        late = np.zeros(len(labels), bool)
        late[order] = ids[order] > least
        parts = np.split(late, np.cumsum(sizes)[:-1])
        kept = [(b, g, np.packbits(p).tobytes()) for b, g, p in zip(table["block"].to_pylist(), table["grp"].to_pylist(), parts) if p.any()]
        columns = list(zip(*kept)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], names=["block", "grp", "late"])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = doc_ids(table["doc_id"])
        w = words(table["text"])
        s = suffixes(w.hashes, w.bounds, ids, plan, width)
        late = np.zeros(len(s.leads), bool)
        lead_group = s.group[s.leads]
        for g, bits in zip(answers["grp"].to_pylist(), answers["late"].to_pylist()):
            a, b = np.searchsorted(lead_group, [g, g + 1])
            late[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[:b - a]
        gone = late[s.run] | (ids[s.doc] > ids[s.doc[s.leads]][s.run]) if len(s.at) else np.zeros(0, bool)
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, s.at[gone], 1)
        np.add.at(edge, s.at[gone] + width, -1)
        covered = np.cumsum(edge)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(covered)])
        removed = removed[w.bounds[1:]] - removed[w.bounds[:-1]]
        kept = []
        for k, t in enumerate(table["text"]):
            parts = (t.as_py() or "").encode().split()
            if removed[k]:
                keep = ~covered[w.bounds[k]:w.bounds[k + 1]]
                parts = [parts[i] for i in np.flatnonzero(keep).tolist()]
            kept.append(b" ".join(parts))
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(np.diff(w.bounds)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept"])

    sent = blocked.groupBy("block").applyInArrow(emit, "grp bigint, block bigint, n bigint, labels binary, n_docs bigint, docs binary, which binary")
    answers = sent.groupBy("grp").applyInArrow(find, "block bigint, grp bigint, late binary")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
