"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from segmentlab.llm import bpe
from segmentlab.llm.queries import op11_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
PATTERN = public_tokenizers.PATTERN
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op11_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library, monkeypatch):
    """Absent, empty and very long texts, repeated rows, and other columns with the operator's own names."""
    texts = [None, "", "a", "a", " \n\t ", "ab" * 200_000 + "!", "é你 𝒳\x00", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)] + [(None, "a", "x", b"y")],
                                 "doc_id long, text string, ids string, bytes binary")
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        text = "a" if row.doc_id is None else texts[row.doc_id] or ""
        if len(text) < 1000:
            assert row.ids == library.encode_ordinary(text)
        assert bytes(row.bytes).decode() == text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)).collect() == []


_TOKENS = [t.decode() for t in bpe.merges_of(RANKS).token if t and t.isascii()]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(_TOKENS), max_size=12).map("".join), st.text("abn ", max_size=80)))
def test_any_text(library, text):
    assert bpe.Encoder(RANKS, PATTERN)([text])[0].as_py() == library.encode_ordinary(text)


def test_lower_rank_made_by_a_higher_one():
    """A merge may make a pair of lower rank; that one goes before the rest of its own rank."""
    single = [bytes([b]) for b in range(256)]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*single, b"xa", b"abc", b"bc", b"abcx"]))
    own = tiktoken.Encoding("own", pat_str=r"\S+", special_tokens={}, mergeable_ranks={
        t: i for i, t in enumerate([*single, b"xa", b"abc", b"bc", b"abcx"])})
    for text in ("xabc", "abcabc", "abcxabc", "bcbcabcx", "axabcxbc", "abcbcxabcbc"):
        assert bpe.Encoder(ranks, r"\S+")([text])[0].as_py() == own.encode_ordinary(text)


def test_forgetting_words(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    encoder = bpe.Encoder(RANKS, PATTERN)
    for text in ("some words are forgotten", "others are learnt again", "some words are learnt " + "x" * 100):
        assert encoder([text])[0].as_py() == library.encode_ordinary(text)
