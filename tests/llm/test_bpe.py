"""Byte-level BPE against the tokenizer's library, and its exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_fixtures import collected, table

from colorway.llm import bpe
from colorway.llm.queries import PATTERN, VOCABULARY, op5_byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        return bpe.Codec(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_random_texts(codec, library):
    rng = random.Random(1)
    alphabet = "ab\n\t  é'sll,.1 2  \x1c\0日本x"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_long_pieces(codec, library):
    for text in ("ab" * 20_000, "=-" * 5000 + "é" * 999, "!" * 3001, " " * 5000 + "x"):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_full_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 2)
    text = "one two three one four five, six two one"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_edges(edges, library):
    got = collected(bpe.round_trip(edges, VOCABULARY, PATTERN))
    want = []
    for r in edges.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted([tuple(g.values()) for g in got], key=key) == sorted(want, key=key)


def test_encode_then_decode(edges):
    back = bpe.decode(bpe.encode(edges, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in edges.collect())


def test_empty(no_docs):
    assert bpe.round_trip(no_docs, VOCABULARY, PATTERN).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in collected(op5_byte_bpe(spark, SF))}
    rows = table(spark, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id]["n_tokens"] == len(ids)
        assert got[r.doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id]["decoded_sha256"] == hashlib.sha256(r.text.encode()).hexdigest()
