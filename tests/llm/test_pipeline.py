"""The pipeline's stages against plain Python over each stage's own input."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from llm_fixtures import table, words
from test_mixing_packing import expected, name_domain
from test_near_copies import brute_force as groups
from test_substrings import WORD

import corpus_pipeline as cp
from colorway.llm import quality
from colorway.llm.bpe import read_ranks
from colorway.llm.queries import MIX, PATTERN, VOCABULARY

SF = "/root/testdata/sf0.01"


def kept_words(rows, n=13):
    first, split = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            first[x] = min(first.get(x, i), i)
    out = {}
    for (i, w), (_, text) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else text
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into and come out of each stage."""
    docs, out = table(spark, "documents", SF), []
    for name, stage in cp.STAGES:
        result = cp.scratch_table(stage(spark, docs, SF), name)
        out.append((name, docs.collect(), result.collect(), docs.columns, result.columns))
        docs = result
    return {name: rest for name, *rest in out}


def test_names_and_columns(stages):
    assert list(stages) == ["quality", "near_copies", "substrings", "mixture", "token_ids"]
    for name, (_, _, before, after) in stages.items():
        assert after == before or name == "token_ids"


def test_quality(spark, stages):
    before, after, *_ = stages["quality"]
    verdicts = quality.classify(table(spark, "documents", SF), table(spark, "labels", SF)).where("predicted = 1").collect()
    assert sorted(after) == sorted(r for r in before if r.doc_id in {v.doc_id for v in verdicts})


def test_near_copies(stages):
    before, after, *_ = stages["near_copies"]
    keep = {i for i, root, _ in groups([(r.doc_id, r.text) for r in before]) if i == root}
    assert sorted(after) == sorted(r for r in before if r.doc_id in keep) and len(after) < len(before)


def test_near_copies_by_text_not_by_id(spark):
    """Different texts under one id stay, copies without an id go, and the row
    that stays does not depend on the order."""
    rng = random.Random(8)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, c, "z"), (3, c, "y"), (None, d, "x"), (None, d, "x"), (None, c + " end", "x"),
            (None, e, "x"), (4, "", "x"), (5, None, "x"), (6, b + " end", "x")]
    want = [(1, a, "x"), (1, b, "x"), (3, c, "y"), (None, d, "x"), (None, e, "x"), (4, "", "x"), (5, None, "x")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string")
        assert sorted(map(tuple, cp.keep_one_of_each_group(spark, docs, SF).collect()), key=str) == sorted(want, key=str)


def test_substrings(stages):
    before, after, *_ = stages["substrings"]
    want = kept_words([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == want
    assert any(r.text != t for r, t in zip(sorted(before), [want[r.doc_id] for r in sorted(before)]))
    assert all(r.n_chars == len(r.text) for r in after)


def test_mixture(stages):
    before, after, *_ = stages["mixture"]
    copies = expected([(r.doc_id, r.text, r.lang, r.source) for r in before], MIX, name_domain)
    assert sorted(after) == sorted(r for k, r in enumerate(before) for _ in range(copies[k]))


def test_token_ids(spark, stages):
    before, after, *_ = stages["token_ids"]
    with open(VOCABULARY, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    want = []
    for r in before:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after)) == sorted(want)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(want)


def test_odd_rows(spark, edges, no_docs):
    """Nulls, repeated rows, empty tables and clashing names, stage by stage."""
    for start in (edges, no_docs):
        docs = start
        for name, stage in cp.STAGES[:-1]:
            if name == "quality":  # no labels here: every text with a word scores one half and stays
                result = quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int"))
            else:
                result = stage(spark, docs, SF)
            result = cp.scratch_table(result, name)
            assert result.columns == start.columns
            docs = result
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
