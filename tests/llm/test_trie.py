"""The conversation trie against one made of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_fixtures import collected

from colorway.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string, depth string, shard string, kind string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            mark = hashlib.md5(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, mark, pair))
    convs = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * (100 if c > 0 else -100)  # as in SQL, towards 0
        turns = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], set()).add(c)
        ends.setdefault(turns, []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        children[p] = children.get(p, 0)
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(nodes[p]) - 1) * len(p[-1][1] if p else "")
        if p:
            for d, x in ((children, 1), (leaves, leaves[p]), (saved, saved[p])):
                d[p[:-1]] = d.get(p[:-1], 0) + x
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items()), key=str)


def result(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "k", "n", "d", "s", "k") for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in collected(trie.nodes(df, **sizes))), key=str)


def conversations(seed, n, longest=9):
    """Few texts, so that many conversations begin alike; some far ids."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        c = rng.choice([k, k, k * 13, 100 * (k % 7), -k])
        if any(r[0] == c for r in rows):
            continue
        rows += [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bb", "ä\U0001f600", None, ""])) for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity", [2, 64])
def test_against_dictionaries(spark, arity):
    rows = conversations(5, 260)
    assert result(spark, rows, shard_turns=60, arity=arity) == brute_force(rows)  # some 20 shards


def test_odd_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(5, None, None, None)], [(205, 0, "u", "x")], [(100, 0, "u", "x"), (101, 0, "u", "x"), (102, 5, "u", "y")],
                 [(7, 1, "u", "x"), (7, 1, "u", "x"), (7, None, "u", "z"), (7, None, None, "z"), (7, -3, "ab", "c"), (7, -3, "a", "bc"),
                  (None, 3, "u", "x"), (-7, 0, "u", "x" * 50_000)]):
        assert result(spark, rows) == brute_force(rows), rows


def test_many_copies_one_first_turn_and_a_long_conversation(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(1000, 1400) for t in range(7)]
    rows += [(c, t, "u", "same 0" if t == 0 else f"{c} {t}") for c in range(1400, 1600) for t in range(8)]
    rows += [(5, t, "u", f"{t}") for t in range(3000)] + [(6, t, "u", f"{t}") for t in range(2990)]
    want = brute_force(rows)
    assert result(spark, rows, shard_turns=300, arity=3) == want
    assert result(spark, rows) == want


def test_long_lists_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, 0, "u", "x") for c in range(40)]
    batch = trie.pa.RecordBatch.from_pydict(
        {"key": [b"k" * 16] * 40, "sizes": [[1]] * 40, "conv_id": list(range(40))},
        schema=trie.pa.schema([("key", trie.pa.binary()), ("sizes", trie.pa.list_(trie.pa.int32())), ("conv_id", trie.pa.int64())]))
    pieces = [r for b in trie.shard_rows(iter([batch])) for r in b.to_pylist() if r["kind"] == 3 and r["nth"] is not None]
    once = sorted({(r["nth"], r["body"]) for r in pieces})
    assert len(once) == 6 and b",".join(b for _, b in once) == ",".join(map(str, range(40))).encode()
    assert result(spark, rows) == brute_force(rows)


def test_findclose_against_a_stack():
    rng = random.Random(1)
    for n in (1, 2, 5, 63, 64, 65, 700, 5000):
        bits, open_ = [1], 1
        left = n - 1
        while open_:
            if left and (open_ == 1 or rng.random() < 0.55):
                bits.append(1)
                open_, left = open_ + 1, left - 1
            else:
                bits.append(0)
                open_ -= 1
        bits = np.array(bits, np.int8)
        stack, want = [], {}
        for k, b in enumerate(bits.tolist()):
            stack.append(k) if b else want.update({stack.pop(): k})
        opens = np.flatnonzero(bits)
        for block in (4, 64):
            assert trie.Parens(bits, block).findclose(opens, 100).tolist() == [want[k] for k in opens.tolist()]


def test_common_prefixes():
    rng = random.Random(2)
    for _ in range(300):
        a = b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randint(0, 20)))
        b = a[:16 * rng.randint(0, 20)] + b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randint(0, 9)))
        want = 0
        while want < min(len(a), len(b)) // 16 and a[16 * want:16 * want + 16] == b[16 * want:16 * want + 16]:
            want += 1
        assert trie._common(a, b) == want
