"""MinHash join against brute force over all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import collected, table, words

from colorway.llm import near_copies as nc
from colorway.llm.components import components
from colorway.llm.queries import op2_minhash_join


def brute_force(rows, threshold=0.8):
    """{row: (class, links)} for rows (id, text), by all pairs that share a shingle."""
    sets = [frozenset(nc.shingles(t or "").tolist()) if i is not None else frozenset() for i, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > k:
                    shared[j] += 1
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[k] += 1
                links[j] += 1
                root[max(find(k), find(j))] = min(find(k), find(j))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, low.get(find(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in collected(df)), key=str)


def test_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert result(nc.join(edges)) == brute_force(rows)


def test_large_group_in_blocks(spark):
    """Near copies of one text, compared block against block, beside copies."""
    rng = random.Random(2)
    base = words(rng, 150).split()
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"w{k}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, words(rng, 60)) for k in range(20)] + [(600 + k, " ".join(base[:130])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nc.join(df, block=25)) == brute_force(rows)


def templates(rng, texts, shared, own):
    """Texts of which a share is one template: many bands in common, no links."""
    base = words(rng, shared)
    return [f"{base} {words(rng, own)}" for _ in range(texts)]


def test_template_texts_are_no_candidates(spark):
    """A third to a half of the words in common: one rough group, of which only
    planted near copies are left to be verified."""
    rng = random.Random(8)
    rows = list(enumerate(templates(rng, 300, 100, 90) + templates(rng, 200, 80, 100)))
    for k in (3, 77, 290, 410):
        w = rows[k][1].split()
        w[-2] = "changed"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert sum(links for *_, links in want) == 8
    assert result(nc.join(df)) == want
    assert result(nc.join(df, block=7)) == want  # sketches in blocks too
    classes = nc.signatures(df.withColumn("mark", nc.mark(df["text"]))).withColumnRenamed("doc_id", "node").checkpoint()
    assert nc.candidates(classes, few=1000).count() > 150  # without the sketches
    planted = {k + x for k in (3, 77, 290, 410) for x in (0, 1000)}
    groups = nc.candidates(classes).collect()
    assert planted <= {r.node for r in groups} and max(Counter(r.root for r in groups).values()) <= nc.FEW
    found = {r.node for r in nc.candidates(classes, few=1).collect()}  # all rough groups refined
    assert planted <= found and len(found) < 20


def test_linked_sketches_agree():
    """Pairs at the threshold, small sets too, stay within the bound on
    differing values; pairs at a third do not."""
    rng = np.random.default_rng(12)
    bands, rows = nc.bands_and_rows()
    n = bands * rows
    a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    most = nc.most_unlike(n)

    def unlike(x, y):
        x, y = (np.unpackbits(np.frombuffer(nc.sketch(nc._minima(v, a, b)), np.uint8)).reshape(2, -1) for v in (x, y))
        return int((x != y).any(axis=0).sum())

    for size in (1, 4, 40, 100):
        for _ in range(1000):
            s = rng.integers(0, 1 << 63, 5 * size).astype(np.uint64)
            assert unlike(s, s[size:]) <= most  # 4 of 5 shared
    far = [unlike(s[:100], s[50:]) for s in rng.integers(0, 1 << 63, (1000, 150)).astype(np.uint64)]
    assert sum(x <= most for x in far) <= 1


def test_forest_of_sketches():
    """Equal to components by all pairs, within one block and between two."""
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, (6, 8)).astype(np.uint64)
    sketches = base[rng.integers(0, 6, 80)] ^ (np.uint64(1) << rng.integers(0, 60, (80, 8)).astype(np.uint64))
    names = rng.permutation(1000)[:80]
    for side in (None, rng.integers(0, 2, 80).astype(bool)):
        root = {int(x): int(x) for x in names}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for i in range(80):
            for j in range(i):
                x = sketches[i] ^ sketches[j]
                if (side is None or side[i] != side[j]) and int(np.bitwise_count(x[:4] | x[4:]).sum()) <= 20:
                    u, v = find(int(names[i])), find(int(names[j]))
                    root[max(u, v)] = min(u, v)
        edges = nc._alike(names, sketches, side, 20)
        assert sorted(edges) == sorted((k, find(k)) for k in root if find(k) != k)


def test_one_id_on_different_texts(spark):
    """Near copies of each other, and of others, under one id; and an id on many texts."""
    rng = random.Random(5)
    base, other = words(rng, 150).split(), words(rng, 90).split()

    def near(text, k):
        return " ".join([*text[:k], f"w{k}", *text[k + 1:]])

    rows = [(1, " ".join(base)), (1, near(base, 3)), (2, near(base, 140)), (1, " ".join(other)), (7, near(other, 5)), (7, near(base, 70)),
            (7, near(base, 70)), (9, near(other, 80)), (2, words(rng, 40))] + [(0, words(rng, 30)) for _ in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nc.join(df)) == brute_force(rows)


def test_empty(no_docs):
    assert nc.join(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands, rows = nc.bands_and_rows(0.8, 0.995, 256)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.995 and bands * rows <= 256


def test_recall_of_banding():
    """Pairs just above the threshold share a band as often as promised."""
    rng = np.random.default_rng(4)
    bands, rows = nc.bands_and_rows()
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    met = 0
    for _ in range(400):
        s = rng.integers(0, 1 << 63, 220).astype(np.uint64)
        x, y = s[:200], s[20:]  # 180 of 220 shared: 0.82
        met += bool(set(nc._band_hashes(x, a, b, bands).tolist()) & set(nc._band_hashes(y, a, b, bands).tolist()))
    assert met >= 0.98 * 400


def test_pairs_at_the_threshold_meet():
    """Every one of 3000 pairs at 0.8: bands of 8 lose about 8 of them."""
    rng = np.random.default_rng(6)
    bands, rows = nc.bands_and_rows()
    assert (1 - 0.8 ** rows) ** bands < 1e-5
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    for _ in range(3000):
        s = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        x, y = nc._band_hashes(s[:180], a, b, bands), nc._band_hashes(s[20:], a, b, bands)  # 160 of 200 shared
        assert set(x.tolist()) & set(y.tolist())


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] \
        + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", sf).collect()]
    assert result(op2_minhash_join(spark, sf)) == brute_force(rows)
