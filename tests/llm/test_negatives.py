"""Hard negatives against all pairs."""

import math

import numpy as np
from llm_fixtures import collected
from pyspark.sql import functions as F

from colorway.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, q string, block string, shard string, rank string"


def brute_force(rows, every, positives=5, negatives=3):
    known = {(i, v if v is None else tuple(v), y) for i, v, y in rows}
    known = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y) for i, v, y in known
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    known = sorted(set(known), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for a, v, y in known:
        if a is None or a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i is None, i or 0, i, z) for i, w, z in known if i != a]
        same = sorted(s for s in scored if s[4] == y)[:positives]
        other = sorted(s for s in scored if s[4] != y)
        for p in same:
            fit = [s for s in other if 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(a, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                   for r in collected(df)), key=str)


def vectors(seed, n, size=12, labels=4):
    """Clusters of close vectors of several lengths, with ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.2, 1.0, 1.0, 3.0])], int(rng.integers(labels))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "q", "b", "s", "r") for r in rows], SCHEMA)


def run(spark, rows, every=5, **sizes):
    return result(ng.mine(frame(spark, rows), ng.every(every), F.col("label"), **sizes))


def test_against_all_pairs(spark):
    rows = vectors(1, 300)
    want = brute_force(rows, 5)
    assert len(want) > 100
    assert run(spark, rows) == want
    assert run(spark, rows, seeds=40, block=16, values=12 * 50) == want  # several blocks and shards, weak thresholds


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, 4, 2) + [
        (None, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 1), (100, None, 1), (105, [1.0, None, 0.0, 0.0], 1),
        (110, [nan, 1.0, 1.0, 1.0], 0), (115, [inf, 1.0, 1.0, 1.0], 0), (120, [1.0, 1.0, 1.0, 1.0], None), (125, [], 1), (130, [2.0], 0),
        (135, [0.0] * 4, 1), (140, [1.5, 0.5, 0.5, 0.5], 0), (140, [1.5, 0.5, 0.5, 0.5], 0), (145, [1.0] * 4, 1), (146, [1.0] * 4, 0)]
    assert run(spark, rows) == brute_force(rows, 5)
    assert run(spark, rows, seeds=4, block=2, values=16) == brute_force(rows, 5)


def test_one_common_vector_and_empty_tables(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(150)] + [(i, [0.4, 0.2, -0.1], i % 3) for i in range(150, 260)]
    assert run(spark, rows, seeds=20, values=90) == brute_force(rows, 5)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor


def test_rows_that_repeat_an_id_each_take_part(spark):
    rows = vectors(3, 40, 4, 2) + [(10, [1.0, 0.0, 0.0, 0.0], 0), (10, [0.0, 1.0, 0.0, 0.0], 1)]
    got = {(r[0], r[1], r[4]) for r in run(spark, rows)}
    assert got == {(r[0], r[1], r[4]) for r in brute_force(rows, 5)}


def test_ranges_lose_no_row_and_do_prune():
    """Every row at the threshold is proposed, and most others are not."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 0.1 for c in centres])
    q = np.floor(1000 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)  # one length bucket
    lengths = np.sqrt((q.astype(float) ** 2).sum(1))
    lists = ng.Lists(q, lengths)
    asked = pruned = 0
    for k in range(0, len(q), 37):
        scores = q @ q[k]
        threshold = np.sort(scores)[-20]
        at = lists.candidates(q[k], lengths[k], threshold)
        asked += 1
        if at is not None:
            assert set(np.flatnonzero(scores >= threshold)) <= set(at.tolist())
            pruned += len(at) < len(q) / 4
    assert pruned > asked / 2


def test_products_are_exact_beyond_doubles():
    a = np.array([[2 ** 40, -3], [1, 2]], np.int64)
    b = np.array([[2 ** 20 + 1, 5], [7, 2 ** 50 + 1]], np.int64)
    assert ng.products(a, b).tolist() == [[2 ** 60 + 2 ** 40 - 15, 7 * 2 ** 40 - 3 * 2 ** 50 - 3], [2 ** 20 + 11, 2 ** 51 + 9]]
    assert ng.products(np.array([[2 ** 62]]), np.array([[2 ** 62]])).tolist() == [[2 ** 63 - 1]]
