import hashlib
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = byte_bpe.Vocabulary(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
TEXT = st.lists(st.sampled_from(["a", "aaaa", "I'll", "'s", "'re", " ", "  ", "\t", "\n", " ", "　", "été", "日本", "12", "٣", "!!", "'", "\x1c", "<|endoftext|>", "😀", "ab" * 9, "x"]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_encode_is_that_of_the_library(texts):
    ids, bounds = byte_bpe.Encoder(VOCABULARY).encode(texts)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == LIBRARY.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_pre_tokens_are_the_matches_of_the_pattern(text):
    want = [m.encode() for m in regex.findall(public_tokenizers.PATTERN, text)]
    assert byte_bpe.Encoder(VOCABULARY).split(text) == want


@pytest.mark.parametrize("piece", ["a" * 5001, "abc" * 3000, "the" * 2000, "é" * 3001, "=" * 4097])
def test_long_pre_tokens(piece):
    encoder = byte_bpe.Encoder(VOCABULARY)
    want = LIBRARY.encode_ordinary(piece)
    assert encoder.merge([piece.encode()])[0].tolist() == want
    assert encoder.merge_one(piece.encode()).tolist() == want


def test_ranks_that_fall_after_a_merge(tmp_path):
    """A merged pair whose neighbour has a lower rank than the pair itself is taken at once, as in the library."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab", b"abab", b"bc", b"aa", b"aaa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    vocabulary = byte_bpe.Vocabulary(str(path))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for word in ["ababc", "abcab", "abab", "aaaaa", "cababcabab", "abcabcabc", "ababababc", "aaabaaabc"]:
        assert byte_bpe.Encoder(vocabulary).encode([word])[0].tolist() == library.encode_ordinary(word)


def test_forgetting_pre_tokens_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    encoder = byte_bpe.Encoder(VOCABULARY)
    for k in range(6):
        texts = [f"word{i * 7 + k} zzqx{i} again" for i in range(40)]
        ids, bounds = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_digest_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (3, " \n\t ", 3), (None, "x y", 4), (4, "Grüße 'll " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = byte_bpe.digest(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {x[0]: x[1] for x in rows}[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    coded = byte_bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "ids"] and dict(coded.dtypes)["ids"] == "binary"
    back = byte_bpe.decode(coded.withColumn("ids", F.when(F.col("doc_id") == 3, F.col("ids"))), PATH).collect()
    assert {r.decoded is None for r in back if r.doc_id != 3} == {True}
    assert byte_bpe.digest(docs.limit(0), PATH).count() == 0


def test_words_are_split_at_ascii_white_space_only():
    texts = ["a b\x0b\x0cc", None, "", " \n ", " x  ", "AB ab", "z"]
    w = words.words(pa.array(texts, pa.string()))
    assert np.diff(w.bounds).tolist() == [len(re.findall(words.WORD, t or "")) for t in texts]
    low = words.words(pa.array(texts, pa.string()), lower=True)
    a, b = low.hashes[low.bounds[5]:low.bounds[6]]
    assert a == b and len(set(w.hashes.tolist())) == len(w.hashes)
    sliced = words.words(pa.array(texts, pa.string()).slice(5, 2))
    assert sliced.hashes.tolist() == w.hashes[w.bounds[5]:].tolist()


def test_runs_inside_documents():
    bounds = np.array([0, 3, 3, 5, 9])
    assert words.inside(bounds, 3).tolist() == [True, False, False, False, False, True, True]
    assert words.shingles(np.arange(2, dtype=np.uint64), 3).tolist() == []
