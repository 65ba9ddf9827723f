"""N-gram Jaccard join by MinHash banding.

A text's set is that of the hashes of its five-word shingles (a shorter text
has one shingle of all its words). Texts with equal sets form a class, which
has a number of its own; one member (the smallest id, of rows that repeat it
the smallest hash of the text) stands for it. The sets of the representatives get
``bands`` * ``rows`` MinHash values; numbers are chosen so that a pair at the
threshold meets in a band with the target probability. Representatives are
shuffled on their band hashes; all that share one get an edge to the smallest
number among them, so a band of n members gives n - 1 edges, not n * n. Connected
components of these edges are rough groups. Texts with little in common can
form a large one (a third of their words from one template is enough), so a
rough group of more than FEW members is refined: its members meet again in each
band that they share, with sketches of 64 bytes (two bits of each MinHash
value), and only pairs whose sketches agree as often as those of linked texts
hold together. Components of these are the candidate groups (``candidates``),
and within one every pair is verified on the full sets. Both comparisons deal a
large group or band over tasks: its members fall into blocks, and each pair of
blocks is compared by one task, sketches by bit counts, sets with a matrix
product of their shingle incidences. A task returns link counts and spanning
forests, never pairs.

``join`` returns one row per row of ``docs``: doc_id, class_id (the smallest
id of the component of linked texts), copies (rows with an equal set) and
n_links (other rows at a similarity of at least the threshold).

Defined results: null texts and texts without a word have no shingles and link
to nothing, so each is a class by itself. Rows with a null id have a null
class and no links. Rows that repeat an id and a text count as copies; rows
that repeat an id with other texts have links and a class each. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut, slices, texts
from colorway.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
HASHES = 256
BLOCK = 1000
FEW = 64
SKETCH_BLOCKS = 4  # blocks of sketches are so many times as large as those of sets
SKETCH_LOSS = 1e-9
WORDS_KEPT = 150_000
_COLUMNS = 2048  # shingles in one matrix product

_words: dict[str, int] = {}
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    if len(_words) >= WORDS_KEPT:
        _words.clear()
    out = _words[word] = xxhash.xxh64_intdigest(word)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def mark(text: Column) -> Column:
    """128-bit hash of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words.get
    h = np.array([known(w) or _hash(w) for w in words], np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = (out + h[k:k + n]) * _C
    return np.unique(_mix(out))


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The longest bands (fewest chance meetings) of at most ``hashes`` values
    in all that let a pair at the threshold meet with probability ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold ** rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (a[:, None] * x[None, k:k + 2048] + b[:, None]).min(axis=1), out=low)
    return low


def _banded(low: np.ndarray, bands: int) -> np.ndarray:
    v = low.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(v.shape[1]):
        out = _mix(out * _C + v[:, k])
    return out.view(np.int64)


def _band_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    return _banded(_minima(s, a, b), bands)


def sketch(low: np.ndarray) -> bytes:
    """Two bits of a hash of each MinHash value: all first bits, then all second ones."""
    bits = np.zeros((2, -(-len(low) // 64) * 64), np.uint8)
    mixed = _mix(low.astype(np.uint64) * _C + _B)
    bits[0, :len(low)] = mixed & np.uint64(1)
    bits[1, :len(low)] = (mixed >> np.uint64(1)) & np.uint64(1)
    return np.packbits(bits, axis=1).tobytes()


def most_unlike(values: int, threshold: float = THRESHOLD, loss: float = SKETCH_LOSS) -> int:
    """How many of a sketch's values may differ, so that a pair at the
    threshold differs in more with probability ``loss`` at most. A value
    differs if the MinHash values do (1 - threshold) and their two bits too."""
    p = (1 - threshold) * 3 / 4
    left, k = 1.0, 0
    while k < values:
        left -= math.comb(values, k) * p ** k * (1 - p) ** (values - k)
        if left <= loss:
            break
        k += 1
    return k


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, digest, bands, sketch): digest of the shingle set (null if
    empty), band hashes and sketch, for ``docs`` (doc_id, mark, text)."""
    bands, rows = bands_and_rows(threshold, recall)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())),
                        ("sketch", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, size) for t in texts(batch)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            minima = [_minima(s, a, b) if len(s) else None for s in sets]
            values = [np.zeros(0, np.int64) if m is None else _banded(m, bands) for m in minima]
            sketches = [None if m is None else sketch(m) for m in minima]
            offsets = pa.array(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()),
                                              pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())), pa.array(sketches, pa.binary())],
                                             schema=schema)

    return docs.mapInArrow(work, "doc_id long, mark binary, digest binary, bands array<long>, sketch binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets, left by right (or by left)."""
    sets = left + (right or [])
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    keep = shared[inverse]
    column = (np.cumsum(shared) - 1)[inverse[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n, total = len(left), int(shared.sum())
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, total + _COLUMNS, _COLUMNS))
    for k in range(len(cuts) - 1):
        c, o = column[cuts[k]:cuts[k + 1]] - k * _COLUMNS, owner[cuts[k]:cuts[k + 1]]
        if len(c):
            x = np.zeros((len(sets), int(c.max()) + 1), np.float32)
            x[o, c] = 1
            out += x[:n] @ (x[n:] if right is not None else x).T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether sets are at least ``threshold`` alike (exactly: 64-bit shingle
    hashes, integer counts), left by right; not a set with itself."""
    both = np.rint(_overlaps(left, right)).astype(np.int64)
    a = np.array([len(s) for s in left], np.int64)
    b = np.array([len(s) for s in right], np.int64) if right is not None else a
    union = a[:, None] + b[None, :] - both
    out = both >= threshold * union - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _forest(ids: list[int], linked: np.ndarray, other: list[int] | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links: each node with the smallest
    one of its component."""
    names = np.array(ids + (other or []))
    n, left = len(names), len(ids)
    free = np.ones(n, bool)
    out = []
    for start in np.argsort(names, kind="stable"):  # so the first one reached is the smallest
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            if other is None:
                found = np.flatnonzero(linked[i] & free)
            elif i < left:
                found = np.flatnonzero(linked[i] & free[left:]) + left
            else:
                found = np.flatnonzero(linked[:, i - left] & free[:left])
            free[found] = False
            todo += found.tolist()
            out += [(int(names[j]), int(names[start])) for j in found]
    return out


def _alike(names: np.ndarray, sketches: np.ndarray, side: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose sketches differ in ``most``
    values at most (pairs of two sides only, if given): each node with the
    smallest one of its component. What is connected is not compared again."""
    order = np.argsort(names, kind="stable")
    names, sketches = names[order], sketches[order]
    side = None if side is None else side[order]
    first, second = np.split(sketches, 2, axis=1)
    free = np.ones(len(names), bool)
    out = []
    for start in range(len(names)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            others = np.flatnonzero(free if side is None else free & (side != side[i]))
            if len(others):
                unlike = np.bitwise_count((first[others] ^ first[i]) | (second[others] ^ second[i])).sum(axis=1)
                found = others[unlike <= most]
                free[found] = False
                todo += found.tolist()
                out += [(int(names[j]), int(names[start])) for j in found]
    return out


def _refine(table: pa.Table, most: int) -> pa.Table:
    """One task's share of the bands: whole small ones, or a pair of blocks of one."""
    band, node, block = (table[c].to_numpy() for c in ("band", "node", "block"))
    sketches = np.array([np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()])
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    order = np.argsort(band, kind="stable")
    edges = []
    for rows in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        edges += _alike(node[rows], sketches[rows], None if one == two else block[rows] == two, most)
    a, b = zip(*set(edges), strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(table: pa.Table, threshold: float, size: int) -> pa.Table:
    """One task's share: whole small groups, or a pair of blocks of one group.
    Returns link counts (kind 0) and edges of spanning forests (kind 1)."""
    kinds, a, b = [], [], []
    rows: dict[int, dict[int, tuple]] = {}  # group -> class -> (block, copies, set)
    for root, node, block, copies, digest, text in zip(
            *(table[c].to_pylist() for c in ("root", "node", "block", "copies", "digest", "text")), strict=True):
        s = shingles(text, size)
        if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # not another text with the same id and mark
            rows.setdefault(root, {})[node] = (block, copies, s)
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    for group in rows.values():
        left = [(i, c, s) for i, (block, c, s) in group.items() if one == two or block == one]
        right = None if one == two else [(i, c, s) for i, (block, c, s) in group.items() if block == two]
        if not left or right == [] or right is None and len(left) < 2:
            continue
        linked = _linked([r[2] for r in left], None if right is None else [r[2] for r in right], threshold)
        sides = [(left, linked @ np.array([r[1] for r in (right or left)], np.int64))]
        if right is not None:
            sides.append((right, linked.T @ np.array([r[1] for r in left], np.int64)))
        for side, counts in sides:
            for r, n in zip(side, counts.tolist(), strict=True):
                if n:
                    kinds.append(0)
                    a.append(r[0])
                    b.append(n)
        for x, y in _forest([r[0] for r in left], linked, None if right is None else [r[0] for r in right]):
            kinds.append(1)
            a.append(x)
            b.append(y)
    return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_SHARE = ("split", "task", "one", "two")


def _dealt(members: DataFrame, key: str, tasks: int) -> DataFrame:
    """``members`` (node, blocks, the group's ``key``) with the shares of work
    (split, task, one, two) that they take part in: groups of one block share
    ``tasks``, of others each pair of blocks is a share of its own."""
    shared = F.array(F.struct(F.pmod(F.xxhash64(key), F.lit(tasks)).alias("task"), F.lit(0).alias("one"), F.lit(0).alias("two")))
    against = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.col(key).alias("task"), F.least(j, "block").alias("one"), F.greatest(j, "block").alias("two")))
    return members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("t", F.explode(F.when(F.col("blocks") == 1, shared).otherwise(against))) \
        .withColumn("split", F.col("blocks") > 1).select("*", "t.task", "t.one", "t.two")


def candidates(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(node, root): the candidate groups of ``classes`` (node, bands, sketch).
    Classes that can have no link may be missing."""
    # rough groups: all members of a band hang on its smallest
    placed = classes.select("node", F.explode("bands").alias("band"))
    low = placed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    edges = placed.join(low, "band").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    rough = lineage_cut(components(edges))
    large = rough.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > few)
    crowd = rough.join(large, "root", "left_semi").select("node")
    many = crowd.count()
    if not many:
        return rough

    # in large ones, members of a band hold together where their sketches agree
    most = most_unlike(math.prod(bands_and_rows(threshold, recall)), threshold)
    placed = classes.join(crowd, "node", "left_semi").select("node", "sketch", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1") \
        .select("band", F.ceil(F.col("members") / F.lit(block * SKETCH_BLOCKS)).cast("int").alias("blocks"))
    dealt = _dealt(placed.join(sizes, "band"), "band", -(-many // BLOCK) * 4).select(*_SHARE, "band", "node", "block", "sketch")
    alike = lineage_cut(dealt.groupBy(*_SHARE).applyInArrow(lambda t: _refine(t, most), "a long, b long"))
    return rough.join(large, "root", "left_anti").select("node", "root").union(components(alike))


def _classes(rows: DataFrame, threshold: float, recall: float, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (doc_id, text, mark): their ``signatures``, and for each
    digest (digest, copies, links, low), where links are those to other
    digests, and low (missing, doc_id, mark) is the smallest row of the
    component of linked texts."""
    signed = lineage_cut(signatures(rows, threshold, recall, size))
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    classes = lineage_cut(signed.where("digest IS NOT NULL").groupBy("digest")
                          .agg(F.min(F.struct(first.alias("row"), "bands", "sketch")).alias("first"), F.count(F.lit(1)).alias("copies"))
                          .select("digest", F.monotonically_increasing_id().alias("node"), F.col("first.row").alias("first"),
                                  "copies", F.col("first.bands").alias("bands"), F.col("first.sketch").alias("sketch")))

    groups = lineage_cut(candidates(classes, threshold, recall, block))

    # verification: small groups together, large ones a block against another
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    firsts = classes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), "copies", "digest")
    members = groups.join(sizes, "root").join(firsts, "node")
    dealt = _dealt(members.join(rows, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))),
                   "root", max(1, -(-groups.count() // block))).select(*_SHARE, "root", "node", "block", "copies", "digest", "text")
    found = lineage_cut(dealt.groupBy(*_SHARE).applyInArrow(lambda t: _verify(t, threshold, size), "kind int, a long, b long"))

    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b")).join(classes.select("node", "first"), "node")
    lows = roots.select("node", "root").join(roots.groupBy("root").agg(F.min("first").alias("low")), "root").select("node", "low")
    return signed, classes.select("digest", "node", "first", "copies").join(links, "node", "left").join(lows, "node", "left") \
        .select("digest", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("low", "first").alias("low"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE,
         id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copies, n_links) of every row."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("doc_id IS NOT NULL").withColumn("mark", mark(F.col("text")))
    signed, classes = _classes(known, threshold, recall, size, block)
    result = classes.select("digest", "copies", F.col("low.doc_id").alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    with_set = signed.where("digest IS NOT NULL").select("doc_id", "digest").join(result, "digest") \
        .select("doc_id", "class_id", "copies", "n_links")
    alone = signed.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id")) \
        .union(rows.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))) \
        .select("doc_id", "class_id", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return with_set.union(alone)


def survivors(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE,
              id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, mark) of the rows that stay if one of each component of linked
    texts does: the smallest id, of rows that repeat it the smallest mark. Rows
    without an id take part, after all others. Texts without a word stay."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("mark", mark(F.col("text")))
    signed, classes = _classes(rows, threshold, recall, size, block)
    return classes.select("low.doc_id", "low.mark").union(signed.where("digest IS NULL").select("doc_id", "mark")).distinct()
