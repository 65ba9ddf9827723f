"""Hard-negative mining by coordinate pruning over length buckets.

Vectors become whole numbers, floor(256 * x). Rows are put in buckets by their
length (a step of RATIO); a bucket is dealt over shards of a bounded number of
values, and anchors over blocks of at most ANCHORS. One task compares one block with
one shard. The shard holds, for each coordinate, its normalised rows sorted by
that coordinate. An anchor looks for rows that score at least t: in a bucket of
lengths up to m such a row lies within the angle arccos(t / (|anchor| * m)) of
the anchor, which bounds its value at each coordinate. The anchor's FOCUS
largest coordinates give such ranges; binary search finds them in the sorted
lists, the narrowest range proposes rows, the other ranges intersect them, and
what is left is verified by its exact inner product. Shards that no row can
reach t in (an angle of no cosine) get no copy of the anchor.

Two passes: ``positives`` finds each anchor's best rows of its own label,
``hard`` the best rows of other labels whose score lies in [LOW, HIGH] % of the
positive's. Each pass starts from a threshold that a fixed sample of at most
SEEDS rows gives (the k-th best of a part is at most the k-th best of all, so
nothing is lost); shards answer with at most k rows for each anchor (and
positive), of which the k best remain.

Defined results: rows with a null label, a null vector or a component that is
null or not finite take no part. Rows equal throughout count once; rows that
repeat an id otherwise each take part, as anchors too, and never meet a row of
their own id. A null id is no anchor and comes after all other ids in ties.
Missing coordinates of a shorter vector count 0; an empty vector scores 0 with
all. Scores beyond 64 bits stay at the limit. Empty tables give no rows. Only
the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE = 256
RATIO = 1.1
SEEDS = 2048
ANCHORS = 1024
VALUES = 1 << 20  # coordinates in one shard
FOCUS = 4
DENSE = 0.4  # a narrowest range of more than this share of the shard proposes nothing
_NULL = (1 << 63) - 1


def every(number: int) -> Callable[[Column], Column]:
    """Anchors: ids divisible by ``number``."""
    return lambda i: i % number == 0


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(row, vec_id, label, q, length, bucket) of the rows that take part."""
    known = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("v")) \
        .where("label IS NOT NULL AND v IS NOT NULL") \
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = known.select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("q")).distinct()
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return lineage_cut(whole.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(_NULL)).alias("vec_id"),
                                    "label", "q", length.alias("length"))
                       .withColumn("bucket", F.floor(F.log(F.greatest("length", F.lit(1.0))) / math.log(RATIO)).cast("int")))


@dataclass(frozen=True)
class Shards:
    """For each length bucket: its first shard, number of shards and longest row."""

    first: dict[int, int]
    parts: dict[int, int]
    longest: dict[int, float]
    total: int

    def reach(self, length: float, threshold: float) -> list[int]:
        """Shards whose rows can score ``threshold`` with a vector of this length."""
        return [s for b, n in self.parts.items() if length * self.longest[b] * (1 + 1e-9) >= threshold
                for s in range(self.first[b], self.first[b] + n)]


def shards_of(rows: DataFrame, values: int = VALUES) -> Shards:
    """One row for each bucket reaches the driver; a double's range has at
    most ln(1.8e308) / ln(RATIO) = 7,447 of them."""
    first, parts, longest, total = {}, {}, {}, 0
    for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most"),
                                        F.max(F.size("q")).alias("size")).orderBy(F.desc("bucket")).collect():
        b = r["bucket"]
        first[b], longest[b] = total, r["most"]
        parts[b] = -(-r["n"] * max(1, r["size"]) // values)
        total += parts[b]
    return Shards(first, parts, longest, total)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes.tolist()] or [np.zeros(0, int)])] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, ``a`` by ``b``."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if not n or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * n
    if most < 2.0 ** 53:  # doubles hold every partial sum
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones in their order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        at = np.sort(np.concatenate((above, level[:k - len(above)])))
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")]


class Lists:
    """Rows of one length bucket in the order of their ids, with the
    normalised rows sorted by each coordinate."""

    def __init__(self, q: np.ndarray, lengths: np.ndarray):
        self.q, self.longest = q, float(lengths.max()) if len(lengths) else 0.0
        self.unit = q / np.maximum(lengths, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._sorted[f] = order, self.unit[order, f]
        return self._sorted[f]

    def candidates(self, anchor: np.ndarray, length: float, threshold: float) -> np.ndarray | None:
        """Places of the rows that may score ``threshold``; None: all may."""
        if threshold <= 0 or not length or not self.q.shape[1]:
            return None
        cosine = threshold / (length * self.longest) if self.longest else math.inf
        if cosine > 1 + 1e-9:
            return np.zeros(0, np.int64)
        n = min(len(anchor), self.q.shape[1])
        unit = anchor[:n] / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist()
        around = math.acos(min(1.0, cosine))
        ranges = []
        for f in focus:
            angle = math.acos(max(-1.0, min(1.0, float(unit[f]))))
            low, high = math.cos(min(math.pi, angle + around)) - 1e-9, math.cos(max(0.0, angle - around)) + 1e-9
            _, values = self._of(f)
            a, b = np.searchsorted(values, (low, high)).tolist()
            ranges.append((b - a, f, a, b, low, high))
        ranges.sort()
        size, f, a, b, _, _ = ranges[0]
        if size > DENSE * len(self.q):
            return None
        at = self._of(f)[0][a:b]
        for _, f, _, _, low, high in ranges[1:]:
            x = self.unit[at, f]
            at = at[(x >= low) & (x <= high)]
        return np.sort(at)


def scored(lists: Lists, anchors: np.ndarray, lengths: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor: places of rows in their order, and their scores; every
    row that scores at least the anchor's threshold is among them."""
    dense = []
    for k in range(len(anchors)):
        at = lists.candidates(anchors[k], float(lengths[k]), float(thresholds[k]))
        if at is None:
            dense.append(k)
        elif len(at):
            yield k, at, products(anchors[k:k + 1], lists.q[at])[0]
    everything = np.arange(len(lists.q))
    for k in range(0, len(dense), 64):
        block = dense[k:k + 64]
        for i, s in zip(block, products(anchors[block], lists.q), strict=True):
            yield i, everything, s


@dataclass
class Side:
    """Rows of a table (row, vec_id, label, q, length) in the order of (vec_id, row)."""

    row: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    q: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Side:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        return cls(*(table[c].to_numpy() for c in ("row", "vec_id", "label")), matrix(table["q"]), table["length"].to_numpy())

    def part(self, keep: np.ndarray) -> Side:
        return Side(self.row[keep], self.ids[keep], self.label[keep], self.q[keep], self.length[keep])


def same_label(anchors: Side, rows: Side, thresholds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places in ``rows``, scores) of the k best other rows of an
    anchor's label that score at least its threshold."""
    for label in np.unique(anchors.label).tolist():
        mine, places = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        if not len(places):
            continue
        part = rows.part(places)
        lists = Lists(part.q, part.length)
        for i, at, s in scored(lists, anchors.q[mine], anchors.length[mine], thresholds[mine]):
            keep = (part.ids[at] != anchors.ids[mine[i]]) & (s >= thresholds[mine[i]])
            at, s = at[keep], s[keep]
            top = best(s, k)
            yield int(mine[i]), places[at[top]], s[top]


def bounds(score: int) -> tuple[int, int]:
    """The lowest and highest score of a hard negative to a positive's score."""
    return -(-LOW * score // 100), HIGH * score // 100


def other_labels(anchors: Side, positive: list[list[int]], floors: list[list[int]], rows: Side,
                 k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, nth positive, places, scores): for each positive's score the k
    best rows of other labels in its bounds that score at least its floor."""
    limits = [[(max(low, f), high) for (low, high), f in zip(map(bounds, p), fl, strict=True)] for p, fl in zip(positive, floors, strict=True)]
    used = [i for i, x in enumerate(limits) if any(low <= high for low, high in x)]
    if not used or not len(rows.ids):
        return
    thresholds = np.array([min(low for low, high in limits[i] if low <= high) for i in used], float)
    lists = Lists(rows.q, rows.length)
    for j, at, s in scored(lists, anchors.q[used], anchors.length[used], thresholds):
        i = used[j]
        high = max(h for low, h in limits[i] if low <= h)
        keep = (rows.label[at] != anchors.label[i]) & (s >= thresholds[j]) & (s <= high) & (rows.ids[at] != anchors.ids[i])
        at, s = at[keep], s[keep]
        for n, (low, high) in enumerate(limits[i]):
            inside = np.flatnonzero((s >= low) & (s <= high)) if low <= high else np.zeros(0, np.int64)
            if len(inside):
                top = inside[best(s[inside], k)]
                yield i, n, at[top], s[top]


_ROW = [("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int64())), ("length", pa.float64())]
_ROW_SQL = "row long, vec_id long, label long, q array<long>, length double"


def _in_order(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch]).sort_by([("vec_id", "ascending"), ("row", "ascending")])


def _grid(rows: DataFrame, shards: Shards, blocks: int) -> DataFrame:
    """The rows with their shard, a copy for each block of anchors."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(b, shards.first[b], shards.parts[b]) for b in shards.first] or [(0, 0, 1)],
                                  "bucket int, __first int, __parts int")  # at most 7,447 rows, see shards_of
    return rows.join(F.broadcast(table), "bucket") \
        .withColumn("shard", F.col("__first") + F.pmod(F.xxhash64("row"), F.col("__parts")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select("block", "shard", "row", "vec_id", "label", "q", "length")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Callable[[Column], Column], label: Column, id_col: str = "vec_id",
         vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         seeds: int = SEEDS, block: int = ANCHORS, values: int = VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its positives (the best rows
    of its label) its best hard negatives. ``anchor`` tells by the id whether a
    row is one; ``label`` is an expression over the columns of ``vectors``."""
    spark = vectors.sparkSession
    importable(spark)
    rows = rows_of(vectors, id_col, vector_col, label)
    shards = shards_of(rows, values)
    asked = rows.where(F.col("vec_id") != _NULL).where(anchor(F.col("vec_id")))
    blocks = max(1, -(-asked.count() // block))
    sample = Side.of(rows.orderBy(F.xxhash64("row"), "row").limit(seeds)
                     .select("row", "vec_id", "label", "q", "length").toArrow())  # at most ``seeds`` rows
    known = spark.sparkContext.broadcast((sample, shards))
    grid = _grid(rows, shards, blocks)
    dealt = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, shards = known.value
        for batch in batches:
            table = _in_order(batch)
            a = Side.of(table)
            floor = np.full(len(a.ids), -2.0 ** 63)
            for i, _, s in same_label(a, sample, floor, positives):
                if len(s) == positives:
                    floor[i] = s[-1]
            reach = [shards.reach(x, t) for x, t in zip(a.length.tolist(), floor.tolist(), strict=True)]
            yield from table.append_column("floor", pa.array(floor, pa.float64())) \
                .append_column("shards", pa.array(reach, pa.list_(pa.int32()))).to_batches()

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if len(left) and len(right):
            floor = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])["floor"].to_numpy()
            a, r = Side.of(left), Side.of(right)
            for i, at, s in same_label(a, r, floor, positives):
                for o, v in zip(out, ([a.row[i]] * len(at), r.row[at], r.ids[at], s), strict=True):
                    o.extend(v)
        return pa.table({n: pa.array(o, pa.int64()) for n, o in zip(("row", "other", "vec_id", "score"), out, strict=True)})

    started = asked.select("row", "vec_id", "label", "q", "length").mapInArrow(first, _ROW_SQL + ", floor double, shards array<int>") \
        .withColumn("block", dealt).withColumn("shard", F.explode("shards")).drop("shards")
    found = started.groupBy("block", "shard").cogroup(grid.groupBy("block", "shard")) \
        .applyInArrow(near, "row long, other long, vec_id long, score long")
    chosen = lineage_cut(_ranked(found, ["row"], positives).select("row", "rank", F.col("vec_id").alias("positive_id"), "score"))
    # at most ``positives`` of an anchor
    of_anchor = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")) \
        .select("row", F.col("p.score").alias("positive"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, shards = known.value
        for batch in batches:
            table = _in_order(batch)
            a, positive = Side.of(table), table["positive"].to_pylist()
            floors = [[-(1 << 63)] * len(p) for p in positive]
            for i, n, _, s in other_labels(a, positive, [list(x) for x in floors], sample, negatives):
                if len(s) == negatives:
                    floors[i][n] = int(s[-1])
            lowest = [min((max(low, f) for (low, high), f in zip(map(bounds, p), fl, strict=True) if low <= high), default=None)
                      for p, fl in zip(positive, floors, strict=True)]
            reach = [[] if t is None else shards.reach(x, t) for x, t in zip(a.length.tolist(), lowest, strict=True)]
            yield from table.append_column("floors", pa.array(floors, pa.list_(pa.int64()))) \
                .append_column("shards", pa.array(reach, pa.list_(pa.int32()))).to_batches()

    def hard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if len(left) and len(right):
            left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            a, r = Side.of(left), Side.of(right)
            for i, n, at, s in other_labels(a, left["positive"].to_pylist(), left["floors"].to_pylist(), r, negatives):
                for o, v in zip(out, ([a.row[i]] * len(at), [n + 1] * len(at), r.row[at], r.ids[at], s), strict=True):
                    o.extend(v)
        return pa.table({n: pa.array(o, pa.int64()) for n, o in zip(("row", "nth", "other", "vec_id", "score"), out, strict=True)})

    again = asked.join(of_anchor, "row").select("row", "vec_id", "label", "q", "length", "positive") \
        .mapInArrow(second, _ROW_SQL + ", positive array<long>, floors array<long>, shards array<int>") \
        .withColumn("block", dealt).withColumn("shard", F.explode("shards")).drop("shards")
    answers = again.groupBy("block", "shard").cogroup(grid.groupBy("block", "shard")) \
        .applyInArrow(hard, "row long, nth long, other long, vec_id long, score long")
    best_of = _ranked(answers, ["row", "nth"], negatives).select("row", "nth", "rank", F.col("vec_id").alias("negative_id"), "score")
    own = asked.select("row", F.col("vec_id").alias("anchor_id"))

    def named(column: str) -> Column:
        return F.when(F.col(column) != _NULL, F.col(column)).alias(column)

    return best_of.join(chosen.select("row", F.col("rank").cast("long").alias("nth"), "positive_id", F.col("score").alias("positive_score")),
                        ["row", "nth"]).join(own, "row") \
        .select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
