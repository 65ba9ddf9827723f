"""IBLT fingerprints: recovered differences against plain sets."""

import hashlib
import random

import numpy as np
from llm_fixtures import collected, table, words

from colorway.llm import fingerprint as fp
from colorway.llm.queries import op4_iblt_fingerprint

SF = "/root/testdata/sf0.001"


def _sets(texts):
    doc, keys = fp.digests(texts)
    return [set(keys[doc == i].tolist()) for i in range(len(texts))]


def test_difference_recovers_exactly():
    rng = random.Random(5)
    a = [words(rng, rng.randint(0, 400)) for _ in range(40)]
    b = [t if k % 4 == 0 else t[:len(t) // 2] + words(rng, k) if k % 4 < 3 else words(rng, 300) for k, t in enumerate(a)]
    doc, keys, sign = fp.difference(fp.digests(a), fp.digests(b), len(a))
    for i, (x, y) in enumerate(zip(_sets(a), _sets(b), strict=True)):
        assert set(keys[(doc == i) & (sign == 1)].tolist()) == x - y
        assert set(keys[(doc == i) & (sign == -1)].tolist()) == y - x


def test_small_sketch_fails_and_larger_ones_succeed():
    a, b = fp.digests(["a\n" * 3]), fp.digests(["\n".join(map(str, range(3000)))])
    one = fp.sketch(*a, 1, fp.CELLS).minus(fp.sketch(*b, 1, fp.CELLS)).peel()
    assert not one[3][0]
    assert len(fp.difference(a, b, 1)[0]) == len(a[0]) + len(b[0])


def _check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = fp.edited(text, following)
        a, b, c = _sets([text, new, following])
        near = [1 - len(a ^ x) / max(1, len(a) + len(x)) for x in (b, c)]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), *(round(n, 9) for n in near)))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    have = [(g["doc_id"], g["n_chars"], g["edited_sha256"], round(g["near_edited"], 9), round(g["near_next"], 9)) for g in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_edges(edges):
    rows = [(r.doc_id, r.text or "") for r in edges.collect()]
    got = collected(fp.with_edits(edges))
    _check(got, rows)
    by_text = {}
    for g in got:
        text = next(t for i, t in rows if i == g["doc_id"] and len(t) == g["n_chars"])
        assert by_text.setdefault(text, g["fingerprint"]) == g["fingerprint"]


def test_single_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(4, "ab cd ef gh")], "doc_id long, text string")
    _check(collected(fp.with_edits(one)), [(4, "ab cd ef gh")])
    assert fp.with_edits(no_docs).count() == 0


def test_many_ranges(spark):
    rows = [(k * k, f"text {k}\nline {k % 3}") for k in range(50)]
    got = fp.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges=37)
    _check(collected(got), rows)


def test_query(spark):
    got = collected(op4_iblt_fingerprint(spark, SF))
    _check(got, [(r.doc_id, r.text) for r in table(spark, "documents").collect()])
    assert np.mean([g["near_edited"] > g["near_next"] for g in got if g["n_chars"] > 300]) > 0.95
