"""Mixing by budgets and packing of ids, against direct computations."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from llm_fixtures import collected, table
from pyspark.sql import functions as F

from colorway.llm import mixing, packing
from colorway.llm.bpe import read_ranks
from colorway.llm.queries import MIX, PATTERN, VOCABULARY, domain, op9_budget_mix, op10_packed_ids


def water_fill(budget, capacities, weights):
    """Splits a budget by weight, again and again, until no child overflows."""
    out = dict.fromkeys(capacities, 0.0)
    room = {k for k, c in capacities.items() if c > 0 and weights.get(k, 1.0) > 0}
    while room and budget > 1e-9:
        total = sum(weights.get(k, 1.0) for k in sorted(room))
        full = {k for k in room if budget * weights.get(k, 1.0) / total >= capacities[k]}
        if not full:
            return {**out, **{k: budget * weights.get(k, 1.0) / total for k in room}}
        out.update({k: capacities[k] for k in full})
        room -= full
        budget -= sum(capacities[k] for k in full)
    return out


def budgets(tokens, target):
    out, tables = {}, (target.domains, target.languages, target.sources)

    def split(prefix, budget):
        level = len(prefix)
        if level == 3:
            out[prefix] = int(budget + 1e-6)
            return
        capacities = {}
        for leaf, n in tokens.items():
            if leaf[:level] == prefix:
                capacities[leaf[level]] = capacities.get(leaf[level], 0.0) + n * target.epochs
        for name, b in water_fill(budget, capacities, tables[level]).items():
            split((*prefix, name), b)

    split((), target.share * sum(tokens.values()))
    return out


def test_water_fill():
    assert water_fill(100, {"a": 10, "b": 1000, "c": 1000}, {"a": 2}) == {"a": 10, "b": 45, "c": 45}
    assert water_fill(10, {"a": 0, "b": 20}, {"a": 9}) == {"a": 0, "b": 10}


def _budgets(spark, tokens, target):
    rows = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "domain string, language string, leaf string, n long")
    return {(r["domain"], r["language"], r["leaf"]): r["budget"] for r in mixing.budgets(rows, target).collect()}


def test_siblings_make_good_before_ancestors(spark):
    """Short French gives to the web's other languages, not to books."""
    tokens = {("web", "fr", "s1"): 10, ("web", "en", "s1"): 1000, ("books", "en", "s2"): 1000}
    target = mixing.Target(domains={"web": 1, "books": 1}, languages={"fr": 1, "en": 1}, share=0.4, epochs=1)
    assert _budgets(spark, tokens, target) == {("web", "fr", "s1"): 10, ("web", "en", "s1"): 392, ("books", "en", "s2"): 402}
    short = _budgets(spark, {**tokens, ("web", "en", "s1"): 100}, target)
    assert short["web", "en", "s1"] == 100 and short["books", "en", "s2"] == 334  # 444 less all of the web


def test_budgets_against_filling_again_and_again(spark):
    rng = random.Random(8)
    for share, epochs in ((0.3, 1), (0.8, 2), (2.5, 2)):
        tokens = {(rng.choice("abc"), rng.choice("xyz"), f"s{k}"): rng.choice([0, 5, 100, 100, 3000]) for k in range(40)}
        target = mixing.Target({"a": 3, "b": 0}, {"x": 0.5}, {"s1": 9, "s2": 0}, share, epochs)
        want = budgets(tokens, target)
        assert _budgets(spark, tokens, target) == {k: want.get(k, 0) for k in tokens}


def expected(rows, target, domain_of):
    """{row number: copies} by sorting each leaf."""
    leaves = {}
    for k, (i, text, lang, source) in enumerate(rows):
        leaves.setdefault((domain_of(source or ""), lang or "", source or ""), []).append((k, i, len((text or "").split()), hashlib.md5((text or "").encode()).hexdigest()))
    supply = {leaf: sum(m[2] for m in x) for leaf, x in leaves.items()}
    wanted, out = budgets(supply, target), {}
    for leaf, members in leaves.items():
        whole = min(target.epochs, wanted.get(leaf, 0) // supply[leaf]) if supply[leaf] else 0
        rest = wanted.get(leaf, 0) - whole * supply[leaf] if whole < target.epochs else 0
        place = lambda m: int(hashlib.md5(f"{'' if m[1] is None else m[1]}:{m[3]}:{whole}:{target.seed}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        total = 0
        for m in sorted(members, key=lambda m: (place(m), m[1] is not None, m[1] or 0, m[3])):
            total += m[2]
            out[m[0]] = whole + int(rest > 0 and total <= rest)
    return out


def name_domain(source):
    return "crawl" if source == "src0" else "web" if source in {f"src{k}" for k in range(1, 10)} else "books"


def _rows(df):
    return sorted(map(str, df.collect()))


def check_mix(docs, target):
    """Rows of ``mix``: every row as often as the sorted leaves say."""
    rows = docs.collect()
    copies = expected([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], target, name_domain)
    got = collected(mixing.select(docs, target, domain))
    assert sorted((str(r["doc_id"]), r["copies"]) for r in got) == sorted((str(rows[k]["doc_id"]), c) for k, c in copies.items())
    # rows equal throughout may swap their copies; all others have their own
    assert _rows(mixing.mix(docs, target, domain)) == sorted(str(rows[k]) for k, c in copies.items() for _ in range(c))


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (0.9, 1), (3.0, 2)])
def test_mix_edges(edges, share, epochs):
    names = ["__id", "__epoch", "mark", "n", "many", "copies", "nth", "m"]
    clashing = edges.select("*", *[F.lit("own").alias(c) for c in names if c not in edges.columns])
    check_mix(clashing, mixing.Target(MIX.domains, MIX.languages, share=share, epochs=epochs))


@pytest.mark.parametrize("share", [0.25, 0.84, 1.3])
def test_mix_of_null_and_repeated_ids(spark, share):
    """1000 rows without an id, 1000 texts under 10 ids, equal rows: the budget holds."""
    schema = "doc_id long, text string, lang string, source string, url string"
    target = mixing.Target(share=share, epochs=2)
    for rows in ([(None, f"w{k} x", "en", "src1", None) for k in range(1000)],
                 [(k % 10, f"w{k} x y", "en", "src1", "u") for k in range(1000)],
                 [(5, "the same text", "en", "src1", "u")] * 300 + [(5, "the same text", "en", "src1", f"{k}") for k in range(30)] + [(5, "the same text", "en", "src1", None)]):
        docs = spark.createDataFrame(rows, schema)
        mixed = mixing.mix(docs, target, domain).collect()
        chosen = sum(r["copies"] for r in mixing.select(docs, target, domain).collect())
        words = len(rows[0][1].split())
        assert len(mixed) == chosen == int(share * len(rows) * words) // words
        if len(set(rows)) == len(rows) == 1000:
            check_mix(docs, target)


def test_mix_empty(no_docs):
    assert mixing.select(no_docs, MIX, domain).count() == 0 and mixing.mix(no_docs, MIX, domain).count() == 0


def test_mix_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, "documents", sf).collect()]
    want = expected(rows, MIX, name_domain)
    assert {r["doc_id"]: r["copies"] for r in collected(op9_budget_mix(spark, sf))} == {rows[k][0]: c for k, c in want.items()}


def test_best_fit_takes_the_least_room():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 40)
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 60))), reverse=True)
        room = []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(size - n)
        rows = packing.best_fit(lengths, size)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[p] for p in r) for r in rows) == sorted(room)


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})


def _check_rows(got, length, pad=50256):
    for r in got:
        ids, positions = (np.frombuffer(r[c], "<u4") for c in ("ids", "positions"))
        ends = r["cu_seqlens"]
        assert len(ids) == len(positions) == length and ends[0] == 0 and ends[-1] == r["n_tokens"] <= length
        assert len(ends) == len(r["doc_ids"]) + 1 == len(r["parts"]) + 1
        for a, b in zip(ends, ends[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert (ids[ends[-1]:] == pad).all()


@pytest.mark.parametrize("end,length,pack_chars", [(50256, 64, 4_000_000), (None, 2048, 9_000)])
def test_pack_edges(edges, library, end, length, pack_chars):
    packed = packing.pack(edges, VOCABULARY, PATTERN, length=length, end=end, pack_chars=pack_chars)
    _check_rows(collected(packed), length)
    tail = [] if end is None else [end]
    want = sorted(((str(r.doc_id), library.encode_ordinary(r.text or "") + tail) for r in edges.select("doc_id", "text").collect()))
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in packing.unpack(packed).collect())
    assert got == [w for w in want if w[1]]


def test_pack_empty(no_docs):
    assert packing.pack(no_docs, VOCABULARY, PATTERN).count() == 0


def test_write(spark, scratch):
    packed = packing.pack(table(spark, "documents"), VOCABULARY, PATTERN)
    packing.write(packed, f"{scratch}/matrix")
    back = spark.read.parquet(f"{scratch}/matrix")
    _check_rows(collected(back), packing.LENGTH)
    assert back.agg(F.sum("n_tokens")).first() == packed.agg(F.sum("n_tokens")).first()


def test_pack_query(spark, library):
    sf = "/root/testdata/sf0.01"
    got = collected(op10_packed_ids(spark, sf))
    assert sum(r["n_tokens"] for r in got) == sum(len(library.encode_ordinary(r.text)) + 1 for r in table(spark, "documents", sf).collect())
    assert sum(r["n_tokens"] for r in got) / (len(got) * packing.LENGTH) > 0.98
