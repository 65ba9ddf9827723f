"""Removal of repeated bytes against all strings of 400 bytes."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_fixtures import collected

from colorway.llm import suffix_ranks as sr


def brute_force(docs, n=sr.LENGTH):
    seen = {}
    for d in docs:
        for p in range(len(d) - n + 1):
            seen[d[p:p + n]] = seen.get(d[p:p + n], 0) + 1
    out = []
    for d in docs:
        marks = np.zeros(len(d) + 1, int)
        for p in range(len(d) - n + 1):
            if seen[d[p:p + n]] > 1:
                marks[p] += 1
                marks[p + n] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).tolist()
        out.append((len(d), np.frombuffer(d, np.uint8)[~gone].tobytes(), list(zip(edges[::2], edges[1::2]))))
    return out


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "b", "p", "n") for r in rows], "doc_id long, text string, body string, part string, nth string")
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["from"], s["to"]) for s in r["spans"]])
                  for r in collected(sr.kept(df, **sizes))), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute_force([(t or "").encode() for _, t in rows]))), key=str)
    assert got == want
    return sum(len(x[3]) for x in want)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh ijklmn") for _ in range(n))


def passages(seed, n):
    """Passages around the threshold in changing contexts, copies, one edit."""
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(380, 900)) for _ in range(8)] + ["ä\U0001f600" * 90, "ab" * 230, prose(rng, 3000)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(shared), prose(rng, rng.randint(0, 500)), rng.choice(shared)[rng.randint(0, 60):]])
                 for _ in range(rng.randint(0, 4))]
        text = "".join(parts)
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1]
            at = rng.randint(0, max(0, len(text) - 1))
            text = text if rng.random() < 0.5 else text[:at] + "X" + text[at + 1:]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 3, "part_batches": 2}, {"most_bytes": 2000, "part_batches": 1}])
def test_against_all_strings(spark, sizes):
    assert check(spark, passages(7, 70), **sizes) > 40


def test_edges(spark):
    rng = random.Random(1)
    text = prose(rng, 2000)
    assert check(spark, [(1, None), (2, ""), (3, "x" * 399), (4, "y" * 400), (5, "y" * 401), (None, text), (None, text), (6, text), (6, text),
                         (7, text[:400]), (8, text[:399]), (9, "z" + text[1:401]), (10, "ab" * 600), (11, prose(rng, 30_000))]) > 5
    assert check(spark, [(1, "a" * 1200)]) == 1  # overlapping strings of one document
    assert check(spark, [(1, text), (2, prose(rng, 3000))]) == 0
    assert check(spark, []) == 0


def test_one_passage_in_many_contexts(spark):
    rng = random.Random(2)
    hot = prose(rng, 420)
    rows = [(i, prose(rng, 150) + hot[i % 7:] + prose(rng, 150)) for i in range(150)]
    assert check(spark, rows, most_rows=10, part_batches=2) == 150


def test_a_witness_lies_inside_settled_copies(spark):
    """A cut passage whose only partners are interiors of exact copies."""
    rng = random.Random(3)
    whole = prose(rng, 3000)
    rows = [(1, whole), (2, whole), (3, prose(rng, 300) + whole[1000:1000 + 430] + prose(rng, 300))]
    assert check(spark, rows, most_rows=1, part_batches=1) == 3


def test_anchors_of_equal_strings_agree():
    """Every window has a phrase, and equal windows have equal first anchors and phrases."""
    rng = random.Random(4)
    core = prose(rng, 400).encode()
    seen = set()
    for k in (0, 13, 150, 299):
        docs = [prose(rng, 250).encode(), prose(rng, k).encode() + core + prose(rng, 300 - k).encode()]
        pack = sr.Pack.of(docs, 400, *sr.anchors(docs))
        a = int(np.searchsorted(pack.start, 250 + k, "right")) - 1
        b = int(pack.last(np.array([250 + k]))[0])
        assert b > a and pack.low[a] <= 250 + k <= pack.high[a]
        seen.add(tuple((pack.at[a:b + 1] - 250 - k).tolist()))
    assert len(seen) == 1


def test_reranked_keeps_order_across_batches():
    rng = np.random.default_rng(5)
    r1, r2 = np.sort(rng.integers(0, 40, 500)), np.zeros(500, np.int64)
    part, n = np.arange(500), np.ones(500, np.int64)
    batches = [sr.pa.RecordBatch.from_arrays([sr.pa.array(x[k:k + 7]) for x in (r1, r2, part, n)], names=["r1", "r2", "part", "n"])
               for k in range(0, 500, 7)]
    out = [r for b in sr.reranked(iter(batches)) for r in b.to_pylist()]
    counts = np.bincount(r1)
    assert len(out) == counts[counts > 1].sum()
    ranks = {r["r1"]: r["rank"] for r in out}
    assert all(ranks[r["r1"]] == r["rank"] for r in out) and sorted(ranks.values()) == [ranks[k] for k in sorted(ranks)]
    assert len(set(ranks.values())) == len(ranks)


def test_too_short_a_length(spark):
    with pytest.raises(ValueError):
        sr.kept(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=100)


def test_anchors_are_the_lowest_of_each_stretch(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(sr, "_CHUNK", 700)
    span = sr.GRAM + sr.WINDOW - 1
    for _ in range(20):
        docs = [prose(rng, rng.choice([0, 5, span - 1, span, span + 1, 400, 2500])).encode() for _ in range(rng.randint(0, 5))] + [b"a" * 300]
        at, start = sr.anchors(docs)
        want, base = [], 0
        for d in docs:
            for p in range(len(d) - span + 1):
                h = sr._grams(np.frombuffer(d[p:p + span], np.uint8))
                want.append((base + p, base + p + int(h.argmin())))
            base += len(d)
        runs = [w for k, w in enumerate(want) if not k or w[1] != want[k - 1][1]]
        assert list(zip(start.tolist(), at.tolist())) == runs


def test_hashes_hold_little_beside_their_sums():
    """Their sums are 8 bytes for each of the text; tables of all powers were 16 more for each hash."""
    text = np.random.default_rng(8).integers(0, 256, 2_000_000, np.uint8)
    sr.Hashes(text[:10], 0)
    tracemalloc.start()
    try:
        both = [sr.Hashes(text, which) for which in (0, 1)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(both) == 2 and peak < 20 * len(text)


def test_hashes_follow_their_definition_across_steps():
    text = np.random.default_rng(9).integers(0, 256, 3 * 16 * sr._STEP // 2 + 5, np.uint8)
    text[-700:] = text[sr._STEP - 350:sr._STEP + 350]
    for which, base in enumerate(sr._BASES):
        h = sr.Hashes(text, which)
        for a, b in ((0, 400), (sr._STEP - 3, sr._STEP + 397), (16 * sr._STEP - 200, 16 * sr._STEP + 200), (len(text) - 400, len(text))):
            x = sum(int(sr._TABLES[which][c]) * pow(base, k, 1 << 64) for k, c in enumerate(text[a:b].tolist())) % (1 << 64)
            assert int(h.of(np.array([a]), np.array([b]))[0]) == (x ^ x >> 31) * int(sr._A) % (1 << 64)
        low = np.array([sr._STEP - 350, len(text) - 700])
        assert len(set(h.of(low, low + 700).tolist())) == 1


def test_results_leave_a_part_pack_by_pack():
    """A part's results are not one batch, which Spark's reader would hold whole."""
    rows = sr.pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [b"text %d" % k for k in range(40)]})
    left = sr.pa.Table.from_batches(sr._packer(5, 1000, 16)(iter([rows])))
    types = {"kind": "int32", "nth": "int64", "body": "binary", "core": "int64", "union": "int64", "settled": "bool", "asked": "bool"}
    info = sr.pa.table({c: sr.pa.array([], t) for c, t in types.items()})
    out = sr._finish(400, 3)((sr.pa.scalar(0),), left.take(list(range(len(left)))[::-1]), info)
    assert [len(b) for b in out.to_batches()] == [5] * 8
    assert out["doc_id"].to_pylist() == list(range(40)) and out["kept"].to_pylist() == rows["text"].to_pylist()


def test_packs_are_not_compressed_twice(spark):
    """Parquet's codec would hold native buffers as large as all packs of a part."""
    rng = random.Random(10)
    docs = spark.createDataFrame([(k, prose(rng, 3000)) for k in range(60)], "doc_id long, text string")
    table, size = sr.packs(docs, "doc_id", "text", 10, 100_000, 16)
    assert size == 180_000 and table.agg({"n_bytes": "sum"}).first()[0] == size
    codecs = set()
    for f in table.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        codecs |= {meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)}
    assert codecs == {"UNCOMPRESSED"}
