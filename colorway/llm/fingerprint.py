"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, long ones cut further behind words chosen
by their hash (and every LONGEST words where there is none), so that an edit
changes only the pieces around it. Each piece has a 64-bit digest of its words; the k-th repetition of a piece in a text has
a digest of its own. A sketch holds three hashed cells per digest, each with a
count, the XOR of digests and the XOR of their check values. Two sketches of
one size subtract cell by cell; the cells of common digests cancel, and
peeling cells of count 1 or -1 recovers the digests that differ. If peeling
gets stuck, both texts are sketched again GROWTH times as large.

Likeness is 1 - differing / all digests of both texts (1 for two empty ones).
The fingerprint is the sketch of the first size and the number of digests in
base64, so equal texts have equal fingerprints; white space between words
does not count.

Sketching and peeling run over a whole batch of texts at once, each text with
its own range of cells. Memory is bounded by a batch: the texts of at most
BATCH_CHARS characters, or one longer text.

``with_edits`` pairs each row with the next one by (id, text), null ids first,
the last row with the first one. Rows are dealt by id quantiles, and the rows
with the smallest id of each range are also given to the range before it, so
there is one shuffle and no global window. Defined results: null texts are
empty; a single row is its own successor; repeated rows follow one another.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import arrow_rows, importable, slices

CELLS = 6  # in each of the three parts of the first sketch
GROWTH = 9
CUT = np.uint64(4)  # one word of so many ends a piece
LONGEST = 16  # words of a piece
BATCH_CHARS = 1_000_000
WORDS_KEPT = 150_000

_words: dict[str, int] = {}
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _hash(word: str) -> int:
    if len(_words) >= WORDS_KEPT:
        _words.clear()
    out = _words[word] = xxhash.xxh64_intdigest(word)
    return out


def digests(texts: list[str], hashed: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, digest) of the pieces of all texts, ordered by both.
    ``hashed`` keeps the word hashes of lines between calls."""
    hashed = {} if hashed is None else hashed
    hashes, line_ends, sizes = [], [], []
    known = _words.get
    at = 0
    for text in texts:
        n = 0
        for line in text.split("\n"):
            words = hashed.get(line)
            if words is None:
                words = hashed[line] = [known(w) or _hash(w) for w in line.split()]
            if words:
                hashes += words
                n += len(words)
                line_ends.append(at + n - 1)
        sizes.append(n)
        at += n
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix(np.array(hashes, np.uint64))
    ends = h % CUT == 0
    ends[line_ends] = True
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    run = np.arange(at) - np.repeat(starts, np.diff(np.append(starts, at)))
    ends |= run % LONGEST == LONGEST - 1
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    lengths = np.diff(np.append(starts, at))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _C))
        place = np.arange(at) - np.repeat(starts, lengths)
        pieces = mix(np.add.reduceat(h * powers[place], starts) ^ lengths.astype(np.uint64))
        doc = np.repeat(np.arange(len(texts)), sizes)[starts]
        order = np.lexsort((pieces, doc))
        doc, pieces = doc[order], pieces[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (pieces[1:] != pieces[:-1]))
        first = np.flatnonzero(new)
        nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        return doc, mix(pieces + nth.astype(np.uint64) * _C)


class Sketches:
    """One sketch of 3 * ``part`` cells for each of ``n`` texts."""

    def __init__(self, n: int, part: int, seed: int):
        self.n, self.part, self.seed = n, part, seed
        self.count = np.zeros(n * 3 * part, np.int64)
        self.key = np.zeros(n * 3 * part, np.uint64)
        self.check = np.zeros(n * 3 * part, np.uint64)

    def put(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Adds digests (sign 1) or takes them away (-1); the touched cells."""
        check = mix(keys ^ _B)
        cells = []
        for j in range(3):
            with np.errstate(over="ignore"):
                slot = mix(keys + np.uint64(self.seed * 3 + j + 1) * _C) % np.uint64(self.part)
            cell = (doc * 3 + j) * self.part + slot.astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, keys)
            np.bitwise_xor.at(self.check, cell, check)
            cells.append(cell)
        return np.concatenate(cells)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.part, self.seed)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties a difference of sketches: (text, digest, sign) of what was
        recovered, and for each text whether all of it was."""
        found: list[tuple] = []
        cells = np.flatnonzero(self.count)
        while len(cells):
            pure = cells[(np.abs(self.count[cells]) == 1) & (self.check[cells] == mix(self.key[cells] ^ _B))]
            if not len(pure):
                break
            doc, keys, sign = pure // (3 * self.part), self.key[pure], self.count[pure]
            order = np.lexsort((keys, doc))
            doc, keys, sign = doc[order], keys[order], sign[order]
            once = np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]))
            doc, keys, sign = doc[once], keys[once], sign[once]
            found.append((doc, keys, sign))
            cells = np.unique(self.put(doc, keys, -sign))
        left = ((self.count != 0) | (self.key != 0)).reshape(self.n, -1).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else \
            [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return *parts, ~left

    def text(self, of: int, total: int) -> str:
        """The cells of one text as base64."""
        a, b = of * 3 * self.part, (of + 1) * 3 * self.part
        return base64.b64encode(total.to_bytes(4, "little") + self.count[a:b].astype("<i4").tobytes()
                                + self.key[a:b].astype("<u8").tobytes()
                                + self.check[a:b].astype("<u4").tobytes()).decode()


def sketch(doc: np.ndarray, keys: np.ndarray, n: int, part: int, seed: int = 0) -> Sketches:
    out = Sketches(n, part, seed)
    out.put(doc, keys, 1)
    return out


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, sign) of the digests that only a (1) or only b (-1) has,
    for ``n`` pairs of texts, from sketches alone."""
    todo = np.arange(n)
    part, seed, out = CELLS, 0, []
    while len(todo):
        at = np.full(n, -1)
        at[todo] = np.arange(len(todo))
        pair = [(at[d][at[d] >= 0], k[at[d] >= 0]) for d, k in (a, b)]
        doc, keys, sign, done = sketch(*pair[0], len(todo), part, seed).minus(sketch(*pair[1], len(todo), part, seed)).peel()
        whole = done[doc]
        out.append((todo[doc[whole]], keys[whole], sign[whole]))
        todo = todo[~done]
        part, seed = part * GROWTH, seed + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else \
        (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    differing = np.bincount(difference(a, b, n)[0], minlength=n)
    total = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    return 1 - differing / np.maximum(total, 1)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the start of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                     ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chosen(every: tuple[np.ndarray, np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, numbered anew in that order."""
    low, high = np.searchsorted(every[0], texts), np.searchsorted(every[0], texts, "right")
    sizes = high - low
    at = np.arange(sizes.sum()) + np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]), sizes)
    return np.repeat(np.arange(len(texts)), sizes), every[1][at]


def _compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of (id, text, next text)."""
    n = len(rows)
    own = [t for _, t, _ in rows]
    new = [edited(t, f) for _, t, f in rows]
    # the next text is mostly the next row's own
    last = [k for k in range(n) if k + 1 == n or rows[k][2] is not own[k + 1]]
    hashed: dict[str, list[int]] = {}
    every = digests(own + [rows[k][2] for k in last], hashed)
    following = np.arange(1, n + 1)
    following[last] = np.arange(n, n + len(last))
    a, c = _chosen(every, np.arange(n)), _chosen(every, following)
    b = digests(new, hashed)
    prints = []
    for doc, keys in (a, b):
        total = np.bincount(doc, minlength=n)
        s = sketch(doc, keys, n, CELLS)
        prints.append([s.text(i, int(total[i])) for i in range(n)])
    return arrow_rows({
        "doc_id": [i for i, _, _ in rows], "n_chars": [len(t) for t in own],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": prints[0], "edited_fingerprint": prints[1],
        "near_edited": likeness(a, b, n).tolist(), "near_next": likeness(a, c, n).tolist()}, _SCHEMA)


def _ranges(ids: DataFrame, n: int) -> tuple[list[int], list[tuple[int, int | None]]]:
    """Bounds of about ``n`` id ranges, and (range, smallest id) of those that
    have rows (None for a null id): both as long as the number of ranges."""
    marks = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.5 / n) if n > 1 else []
    bounds = sorted({int(x) for x in marks})

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        null = False
        for batch in batches:
            column = batch.column("doc_id")
            null |= column.null_count > 0
            own = np.sort(column.drop_null().to_numpy())
            ranges, first = np.unique(np.searchsorted(bounds, own), return_index=True)
            for r, i in zip(ranges.tolist(), own[first].tolist(), strict=True):
                low[r] = min(low.get(r, i), i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*low, *[0] * null], pa.int32()), pa.array([*low.values(), *[None] * null], pa.int64())],
            names=["range", "low"])

    found = ids.mapInArrow(lowest, "range int, low long").groupBy("range") \
        .agg(F.min("low").alias("low"), F.max(F.col("low").isNull()).alias("null")).collect()
    return bounds, sorted((r["range"], None if r["null"] else r["low"]) for r in found)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, both
    fingerprints, near_edited and near_next."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, lows = _ranges(rows.select("doc_id"), n)
    ahead = {low: lows[k - 1][0] for k, (_, low) in enumerate(lows)}  # smallest id -> range before (the last's: the first)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            own = [0 if i is None else bisect_left(bounds, i) for i in ids]  # as searchsorted
            more = [k for k, i in enumerate(ids) if i in ahead]
            take = pa.array([*range(len(ids)), *more], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*own, *[ahead[ids[k]] for k in more]], pa.int32()),
                 pa.array([False] * len(ids) + [True] * len(more)),
                 batch.column("doc_id").take(take), batch.column("text").take(take)],
                names=["range", "ahead", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, ready, chars = None, [], 0
        for batch in slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text")), strict=True):
                if pending is not None and pending[0] == row[0]:
                    ready.append((pending[2], pending[3], row[3]))
                    chars += len(pending[3])
                pending = None if row[1] else row  # what lies ahead is another range's row
                if chars > BATCH_CHARS or len(ready) >= 4000:
                    yield _compared(ready)
                    ready, chars = [], 0
        if ready:
            yield _compared(ready)

    dealt = rows.mapInArrow(deal, "range int, ahead boolean, doc_id long, text string")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "ahead", "doc_id", "text") \
        .mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
