"""Byte-level BPE with a rank queue, and its inverse.

The pre-tokens of a batch lie in one linked list of tokens with a barrier after each; the list is merged rank by rank.
Buckets per merge rank hold list positions; a hierarchical bitmap over the ranks finds the next rank by its first set bit;
entries whose pair has changed are stale and skipped.  One pre-token of many megabytes costs no more per byte than many
short ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.words import ODD, bounded, mix

#: Bytes that are encoded together; a longer text is encoded alone.
BATCH = 3 << 20
#: Distinct pre-tokens whose ids a task remembers before it starts anew.
REMEMBERED = 1 << 20

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3


class RankBitmap:
    """A set of ranks.  One bit per rank, above it one bit per non-empty word of 64, and so on up to a single word."""

    def __init__(self, size: int):
        self.levels: list[dict[int, int]] = [{}]
        while size > 64:
            size = (size + 63) >> 6
            self.levels.append({})

    def add(self, rank: int) -> None:
        for level in self.levels:
            word = level.get(rank >> 6, 0)
            level[rank >> 6] = word | 1 << (rank & 63)
            if word:
                return
            rank >>= 6

    def pop(self) -> int | None:
        """Takes out the least rank."""
        rank = 0
        for level in reversed(self.levels):
            word = level.get(rank)
            if not word:
                return None
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            level[at >> 6] ^= 1 << (at & 63)
            if level[at >> 6]:
                break
            del level[at >> 6]
            at >>= 6
        return rank


class Vocabulary:
    """A rank file as arrays: ids of single bytes, ranks of all pairs of tokens, bytes of all tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(left << 32 | right, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
                 if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] + [-1], np.int64)
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.kinds = character_kinds()

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, -1 for none; an id of -1 has no pairs."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[points[m.start():m.end()]] = kind
    return kinds


def pre_tokens(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which characters start a pre-token.

    ``points``: code points of all texts; ``first``: where a text starts.  The rule is that of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: runs of one kind, a single
    space before a run belongs to it, other white space before it stands alone, and a suffix after an apostrophe that
    starts a match is cut off.
    """
    n = len(points)
    kind = kinds[points]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new |= first
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first[1:])  # last white space before a run
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & new)
    if len(quote):
        text = np.cumsum(first)
        letters = [np.where(at < n, np.where(text[np.minimum(at, n - 1)] == text[quote], points[np.minimum(at, n - 1)], 0), 0) for at in (quote + 1, quote + 2)]
        one = np.isin(letters[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (letters[0] == ord(a)) & (letters[1] == ord(b))
        new[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        new[after[after < n]] = True
    return new


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pre-tokens, sorted
        self.known_at, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text."""
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        first = np.zeros(len(points) + 1, bool)
        first[begins] = True
        starts = np.flatnonzero(pre_tokens(points, first[:-1], self.v.kinds))
        width = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
        at = np.append(width[starts], len(data))
        text_at = np.searchsorted(starts, begins)
        del points, first
        hashes = self.hashes(data, at)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.learn(distinct, [data[at[i]:at[i + 1]].tobytes() for i in sample[~np.isin(distinct, self.known)].tolist()])
        place = np.searchsorted(self.known, distinct)
        counts = self.known_n[place][which]
        out = gather(self.ids, self.known_at[place][which], counts)
        bounds = np.concatenate([[0], np.cumsum(counts)])[text_at]
        # two pre-tokens with one hash would show here; the texts are then encoded one by one without hashes
        decoded, ends = decode_ids(self.v, out, bounds)
        if len(decoded) != len(data) or not np.array_equal(decoded, data):
            lists = [self.merge(self.split(t))[0] for t in texts]
            out, bounds = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return out, bounds

    def split(self, text: str) -> list[bytes]:
        if not text:
            return []
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[0] = True
        starts = [*np.flatnonzero(pre_tokens(points, first, self.v.kinds)).tolist(), len(text)]
        return [text[a:b].encode() for a, b in zip(starts, starts[1:])]

    @staticmethod
    def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        sizes = np.diff(at)
        within = np.arange(len(data), dtype=np.int64) - np.repeat(at[:-1], sizes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), ODD)]), dtype=np.uint64)
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)[data] * powers[within]
        return mix(np.add.reduceat(values, at[:-1]))

    def learn(self, distinct: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes the pre-tokens that are not known yet."""
        if not pieces:
            return
        fresh = distinct[~np.isin(distinct, self.known)]
        if len(self.known) + len(fresh) > REMEMBERED and len(self.known):
            keep = np.isin(self.known, distinct)
            self.ids = gather(self.ids, self.known_at[keep], self.known_n[keep])
            self.known, self.known_n = self.known[keep], self.known_n[keep]
            self.known_at = np.cumsum(self.known_n) - self.known_n
        ids, n = self.merge(pieces)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, fresh])
        order = np.argsort(known, kind="stable")
        self.known, self.known_at, self.known_n = known[order], np.concatenate([self.known_at, at])[order], np.concatenate([self.known_n, n])[order]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens and their numbers: one id if it is a token, else the pairs of least rank are merged,
        leftmost first."""
        whole = np.array([self.v.ranks.get(p, -1) for p in pieces], np.int64)
        counts = np.ones(len(pieces), np.int64)
        todo = np.flatnonzero(whole < 0)
        ids, counts[todo] = self.merge_list([pieces[i] for i in todo.tolist()])
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[at[whole >= 0]] = whole[whole >= 0]
        out[gather(np.arange(len(out)), at[todo], counts[todo])] = ids
        return out, counts

    def merge_list(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        token = self.v.byte_ids[raw]
        token[ends - 1] = -1  # barriers
        n = len(token)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.v.pair(token[:-1], token[1:])
        bitmap, buckets = RankBitmap(self.v.size), {}

        def push(positions: np.ndarray) -> None:
            positions = positions[pair[positions] >= 0]
            ranks = pair[positions]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)] if len(ranks) else []
            for a, b in zip(cuts, cuts[1:]):
                rank = int(ranks[a])
                if rank in buckets:
                    buckets[rank].append(positions[a:b])
                else:
                    buckets[rank] = [positions[a:b]]
                    bitmap.add(rank)

        push(np.arange(n))
        odd: set[int] = set()
        while (rank := bitmap.pop()) is not None:
            entries = buckets.pop(rank)
            i = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            i = i[pair[i] == rank]
            if not len(i):
                continue
            if len(i) > 1 and (linked := following[i[:-1]] == i[1:]).any():  # of overlapping pairs every other one, from the left
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~linked]), np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - run) % 2 == 0]
            second = following[i]
            end = following[second]
            following[i] = end
            token[i] = rank
            token[second] = -2
            pair[second] = -1
            before[end[end < n]] = i[end < n]
            left = before[i]
            pair[i] = self.v.pair(token[i], token[np.minimum(end, n - 1)])
            has_left = left >= 0
            left, right = left[has_left], i[has_left]
            pair[left] = self.v.pair(token[left], token[right])
            touched = np.concatenate([i, left])
            if ((pair[touched] >= 0) & (pair[touched] < rank)).any():  # a lower rank after a higher one: order within the pre-token counts
                odd.update(np.searchsorted(ends, touched[(pair[touched] >= 0) & (pair[touched] < rank)], "right").tolist())
            push(touched)
        alive = np.flatnonzero(token >= 0)
        upto = np.concatenate([[0], np.searchsorted(alive, ends)])
        ids, counts = token[alive].astype(np.uint32), np.diff(upto)
        if odd:
            parts = [ids[a:b] for a, b in zip(upto, upto[1:])]
            for k in odd:
                parts[k] = self.merge_one(pieces[k])
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def merge_one(self, raw: bytes) -> np.ndarray:
        """The same for one pre-token, a pair at a time."""
        n, get, bitmap, buckets = len(raw), self.v.ranks.get, RankBitmap(self.v.size), {}
        following, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def push(i: int) -> None:
            rank = get(raw[i:following[following[i]]]) if following[i] < n else None
            pair[i] = -1 if rank is None else rank
            if rank is not None:
                buckets.setdefault(rank, set()).add(i)
                bitmap.add(rank)

        for i in range(n):
            push(i)
        while (rank := bitmap.pop()) is not None:
            valid = {i for i in buckets.pop(rank) if pair[i] == rank}
            if not valid:
                continue
            i = min(valid)
            if len(valid) > 1:
                buckets[rank] = valid - {i}
                bitmap.add(rank)
            second = following[i]
            following[i] = following[second]
            pair[second] = -1
            if following[i] < n:
                before[following[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(get(raw[i:following[i]]))
            i = following[i]
        return np.array(ids, np.uint32)


def gather(values: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slices values[at:at + count], one after another."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(at - ends + counts, counts)]


def decode_ids(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and the bounds in bytes for bounds in ids."""
    if len(ids) and int(ids.max()) >= v.size:
        raise ValueError("an id lies outside the vocabulary")
    counts = v.at[ids.astype(np.int64) + 1] - v.at[ids]
    return gather(v.data, v.at[ids], counts), np.concatenate([[0], np.cumsum(counts)])[bounds]


def groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of at most BATCH in all, one row at least."""
    total = first = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > BATCH:
            yield first, i
            total, first = 0, i
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def binaries(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    at = (bounds * data.itemsize).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids``: the token ids of the whole text as little-endian 32-bit integers in one binary value.

    A pre-token that is in the vocabulary is one token, any other is merged by rank.  A null text gives no ids (an empty
    value), as an empty one does.  Columns named like ``ids`` or ``decoded`` are replaced; all others stay as they are.
    With ``decoded`` the bytes of the ids are added as well, in the same pass.  The vocabulary is read on the driver and
    broadcast: its size is that of the rank file, whatever the documents.  It must hold all 256 single bytes.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    added = [c for c in (ids, decoded) if c]
    docs = docs.drop(*[c for c in added if c != text])
    kept = T.StructType([f for f in docs.schema if f.name not in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in bounded(batches, BATCH, text):
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            out, bounds = encoder.encode(column.to_pylist())
            new = [pa.array(binaries(out.astype("<u4"), bounds), pa.binary())]
            if decoded:
                new.append(pa.array(binaries(*decode_ids(vocabulary.value, out, bounds)), pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], *new], [*kept.names, *added])

    return docs.mapInArrow(run, T.StructType([*kept, *[T.StructField(c, T.BinaryType()) for c in added]]))


def decode(docs: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds ``data``: the bytes that the ids stand for.  Null stays null; an id outside the vocabulary is an error."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    @F.arrow_udf("binary")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[bytes] = []
            for a, b in groups(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
                values = column.slice(a, b - a).to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in values])]).astype(np.int64)
                texts = binaries(*decode_ids(vocabulary.value, np.frombuffer(b"".join(x or b"" for x in values), "<u4"), bounds))
                out += [None if x is None else t for x, t in zip(values, texts)]
            yield pa.array(out, pa.binary())

    return docs.withColumn(data, run(F.col(ids)))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, hash of the ids and hash of the decoded bytes."""
    coded = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
