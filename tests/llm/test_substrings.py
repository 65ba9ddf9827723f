"""Substring removal against a direct search over all windows."""

import hashlib
import random
import re

import pytest
from llm_fixtures import collected, table, words

from colorway.llm import substrings as ss
from colorway.llm.queries import op7_suffix_automata

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, n=ss.LENGTH):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, w in split:
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            first[x] = min(first.get(x, rank(i)), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < rank(i):
                gone[k:k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in collected(df)), key=str)


def test_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert result(ss.digests(edges)) == brute_force(rows)


def passages(seed, n_docs):
    """Texts put together from shared passages, near copies and repeats."""
    rng = random.Random(seed)
    shared = [words(rng, rng.randint(10, 60)) for _ in range(12)]
    hot = words(rng, 20)
    rows = []
    for i in range(n_docs):
        parts = [rng.choice([rng.choice(shared), words(rng, rng.randint(1, 30)), "a b a b " * rng.randint(1, 9)]) for _ in range(rng.randint(0, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), hot)
        text = " ".join(parts)
        if rng.random() < 0.2 and rows:
            w = rng.choice(rows)[1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            text = "\n".join(w)
        rows.append((rng.choice([i, i * 7 + 1]), text))
    return rows


@pytest.mark.parametrize("seed,split", [(1, 4000), (2, 3), (3, 10)])
def test_passages(spark, seed, split):
    rows = passages(seed, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ss.digests(df, split=split)) == brute_force(rows)


def test_small_alphabet(spark):
    """Texts of two words: every state of the automaton has many suffixes."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    assert result(ss.digests(spark.createDataFrame(rows, "doc_id long, text string"), length=6)) == brute_force(rows, 6)


def test_automaton_knows_all_its_substrings():
    rng = random.Random(5)
    for _ in range(150):
        a = ss.Automaton()
        added = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        for s in added:
            a.add(s)
        text = [rng.randrange(3) for _ in range(80)]
        got = a.matched(text, 5)
        want = [k >= 4 and any(text[k - 4:k + 1] == s[j:j + 5] for s in added for j in range(len(s) - 4)) for k in range(80)]
        assert got.tolist() == want


def test_cleaned_texts(spark, edges):
    rows = {(r.doc_id, r.text) for r in edges.collect()}
    out = ss.cleaned(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    digests = {(r["doc_id"], r["kept_sha256"]): r for r in collected(ss.digests(edges))}
    for r in out.collect():
        if (r.doc_id, r.text) not in rows:
            d = digests[r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()]
            assert d["n_removed"] and r.n_chars == len(r.text)


def test_empty(no_docs):
    assert ss.digests(no_docs).count() == 0 and ss.cleaned(no_docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", sf).collect()]
    assert result(op7_suffix_automata(spark, sf)) == brute_force(rows)


def test_a_common_phrase_in_ever_other_contexts(spark):
    """Its anchors are common, no window is: nothing goes, and no stretch of it
    is sent to a shard. With a longer phrase the windows inside go."""
    rng = random.Random(9)
    for size, gone in ((5, False), (16, True)):
        phrase = words(rng, size)
        rows = [(i, " ".join((words(rng, 14), phrase, words(rng, 14)))) for i in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = result(ss.digests(df, split=20))
        assert got == brute_force(rows) and any(r[2] for r in got) == gone
        batch = list(ss._batches(df.select("doc_id", rowbinary(df)).coalesce(1), 1, ss.LENGTH).toArrow().to_batches())
        table_ = ss.pa.Table.from_batches(batch)
        packed, entries = table_.filter(ss.pa.compute.less(table_["bucket"], 0)), table_.filter(ss.pa.compute.equal(table_["bucket"], 0))
        stretches = ss._stretches(packed, ss._answers(entries, 20), ss.LENGTH).to_pylist()
        per_shard = {}
        for r in stretches:
            if r["shard"]:
                per_shard[r["first"]] = per_shard.get(r["first"], 0) + 1
        assert max(per_shard.values(), default=0) <= 20
        hashes = [r["words"][:16] for r in stretches if not r["shard"]]
        assert len(set(hashes)) == len(hashes)  # each once for a batch


def rowbinary(df):
    return df["text"].cast("binary").alias("text")
