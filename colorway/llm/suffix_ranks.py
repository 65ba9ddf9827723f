"""Suffix-array dedup by distributed prefix doubling over sampled positions.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere
(in the same document or another). Ranking the suffixes of all byte positions
would sort many times the text's own size, so only a sample is ranked: in every
stretch of WINDOW positions the one whose GRAM bytes hash lowest is an anchor.
A string of LENGTH bytes fixes its own inner anchors, so equal strings have
equal ones, and the *phrases* from one anchor to the next agree too.

1. Documents are packed, and each pack's anchors are found. Phrases are ranked
   by sorting them; those that occur once are dropped.
2. Prefix doubling: in round k, Spark sorts the pairs (rank at anchor i, rank
   at anchor i + 2**k) and reranks the runs of equal pairs; a pair that occurs
   once is unique and its anchor is dropped. Runs of phrases longer than LENGTH
   bytes are past the threshold and no longer sorted. It ends when no pair is
   left. An anchor keeps the highest round that it survived.
3. Strings whose inner phrases are not shared, by these ranks, occur once. An
   anchor stands for the windows whose first inner anchor it is; where some are
   left, their common core and their union are hashed. Two equal unions settle
   all their windows at once. Where cores agree but some union is alone (at the
   edges of a repeated passage), the windows left are hashed one by one, those
   of one member of each settled union being the witnesses.
4. Windows that occur twice and settled unions give the bytes to remove.

Packs lie in a table bucketed by part (several packs), so the text is not
shuffled again: only ranks, pairs and hashes move. Every part sends a pair,
core, union or window once, with its count, so a passage that a third of all
documents share is one row of each part. Settled results rest on 128 bits of
hash, windows on 80. Memory: a task holds the packed texts of a part, compressed,
some 20 bytes for each byte of one pack (at most BATCH_BYTES, or one document)
and 30 for each window that the part asks about; or a range of pairs as a
stream; or one bucket of window hashes.

Defined results: null texts are empty; an empty or short text keeps all. Every
row gives one row, also rows that repeat an id or are equal throughout (whose
strings of LENGTH bytes then all occur twice). Null ids stay. Only the named
columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut, slices
from colorway.session import range_partitions, scratch_dir

LENGTH = 400
GRAM, WINDOW = 12, 188  # GRAM + WINDOW - 1 is at most half of LENGTH: so each window holds a phrase
BATCH_ROWS, BATCH_BYTES, PART_BATCHES = 512, 2_000_000, 16
BUCKET_BYTES = 32_000_000
_CHUNK, _STEP = 1 << 18, 1 << 12

_A, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), np.uint64)
_ZSTD = pa.Codec("zstd", compression_level=5)


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of n neighbours from each place on."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[:len(x) - step], x[step:])
        done += step
    return x


def _grams(text: np.ndarray) -> np.ndarray:
    """32-bit hashes of the GRAM (12) bytes from each place on."""
    one = text.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    h = (four[:-8] | four[4:-4] << np.uint64(32)) * _A
    h = ((h ^ h >> np.uint64(29)) + four[8:]) * _C
    return (h ^ h >> np.uint64(32)) * _A >> np.uint64(32)


class Powers:
    """Powers of a base modulo 2**64: each a product of two from short tables,
    as a table of all would be eight times the text."""

    def __init__(self, base: int):
        self.fine, self.coarse, self.stride = self._first(base, _STEP), np.ones(1, np.uint64), pow(base, _STEP, 1 << 64)

    @staticmethod
    def _first(base: int, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    def to(self, n: int) -> Powers:
        """With exponents below ``n``."""
        if len(self.coarse) * _STEP < n:
            self.coarse = self._first(self.stride, -(-n // _STEP))
        return self

    def stretch(self, at: int, n: int) -> np.ndarray:
        """The powers of n exponents from ``at`` on, a multiple of _STEP."""
        k = at // _STEP
        return (self.coarse[k:k - (-n // _STEP), None] * self.fine).ravel()[:n]

    def at(self, k: np.ndarray) -> np.ndarray:
        return self.coarse[k // _STEP] * self.fine[k % _STEP]


_POWERS = [(Powers(b), Powers(pow(b, -1, 1 << 64))) for b in _BASES]


class Hashes:
    """Hashes of any stretch of a text, from its prefix sums."""

    def __init__(self, text: np.ndarray, which: int):
        up, self.down = (p.to(len(text) + 1) for p in _POWERS[which])
        self.sums = np.zeros(len(text) + 1, np.uint64)
        for c in range(0, len(text), 16 * _STEP):
            x = _TABLES[which][text[c:c + 16 * _STEP]]
            x *= up.stretch(c, len(x))
            x[:1] += self.sums[c:c + 1]
            np.cumsum(x, out=self.sums[c + 1:c + 1 + len(x)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (self.sums[high] - self.sums[low]) * self.down.at(low)
        return (h ^ h >> np.uint64(31)) * _A


def anchors(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents, end to end, and for each the first
    of the stretches (of GRAM + WINDOW - 1 bytes) whose anchor it is: those up
    to the next anchor's first."""
    text = np.frombuffer(b"".join(docs), np.uint8)
    sizes = np.array([len(d) for d in docs], np.int64)
    span, at, start = GRAM + WINDOW - 1, [], []
    last = -1
    ends = np.cumsum(sizes)
    for c in range(0, max(0, len(text) - span + 1), _CHUNK):
        h = _grams(text[c:c + _CHUNK + span - 1])
        low = (_low(h << np.uint64(32) | np.arange(len(h), dtype=np.uint64), WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        new = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        place = low[new].astype(np.int64) + c
        new += c
        if place[0] == last:
            place, new = place[1:], new[1:]
        if len(place):
            at.append(place)
            start.append(new)
            last = int(place[-1])
    # stretches that leave their document are none: cut the runs at the documents' ends
    at, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, start))
    stop = np.append(start[1:], len(text) - span + 1) if len(start) else start
    full = sizes >= span
    low, high = (ends - sizes)[full], ends[full] - span + 1  # of each document's stretches
    first, past = np.searchsorted(stop, low, "right"), np.searchsorted(start, high, "left")
    run = np.repeat(first - np.append(0, np.cumsum(past - first)[:-1]), past - first) + np.arange(int((past - first).sum()))
    return at[run], np.maximum(start[run], np.repeat(low, past - first))


@dataclass
class Pack:
    """Documents, end to end, with their anchors."""

    text: np.ndarray
    cuts: np.ndarray  # documents' ends, after a 0
    length: int
    at: np.ndarray  # places of the anchors
    start: np.ndarray  # the first stretch of each
    low: np.ndarray  # by anchor: first and last place of its windows; -1 if none
    high: np.ndarray
    need: np.ndarray  # phrases in all of its windows
    _hashes: dict[int, Hashes]

    @classmethod
    def of(cls, docs: list[bytes], length: int, at: np.ndarray, start: np.ndarray) -> Pack:
        text = np.frombuffer(b"".join(docs), np.uint8)
        cuts = np.append(0, np.cumsum([len(d) for d in docs], dtype=np.int64))
        end = cuts[np.searchsorted(cuts, at, "right")] if len(at) else at
        stop = np.minimum(np.append(start[1:], len(text)), end - (GRAM + WINDOW - 1) + 1) - 1
        low, high = start.copy(), np.minimum(stop, end - length)
        low[high < low] = -1
        pack = cls(text, cuts, length, at, start, low, high, np.zeros(len(at), np.int64), {})
        k = np.flatnonzero(low >= 0)
        pack.need[k] = pack.last(low[k]) - k
        return pack

    def last(self, windows: np.ndarray) -> np.ndarray:
        """The last inner anchors of the windows at these places."""
        return np.searchsorted(self.start, windows + self.length - (GRAM + WINDOW - 1), "right") - 1

    def hashes(self, which: int) -> Hashes:
        if which not in self._hashes:
            self._hashes[which] = Hashes(self.text, which)
        return self._hashes[which]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, hash) of each phrase: from an anchor through the next one's bytes."""
        doc = np.searchsorted(self.cuts, self.at, "right")
        k = np.flatnonzero(doc[1:] == doc[:-1])
        return k, self.hashes(0).of(self.at[k], self.at[k + 1] + GRAM).view(np.int64)

    def cores(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what all windows of an anchor share wherever it stands,
        and of all its windows' union with their places."""
        if not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        core = self.hashes(0).of(self.at[k], self.at[k] + self.length - WINDOW + 1)
        union = self.hashes(1).of(self.low[k], self.high[k] + self.length)
        union = (union + (self.at[k] - self.low[k]).astype(np.uint64)) * _C + (self.at[k] - self.high[k]).astype(np.uint64)
        return core.view(np.int64), union.view(np.int64)

    def windows(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 16 bits of hash of the windows at places p."""
        if not len(p):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        return self.hashes(0).of(p, p + self.length), (self.hashes(1).of(p, p + self.length) >> np.uint64(48)).astype(np.uint16)


def _shared(level: np.ndarray, start: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Whether runs of phrases from anchors on may occur twice, by the rounds
    that their halves (which may overlap) survived."""
    k = np.frexp(np.maximum(phrases, 1).astype(float))[1] - 1
    return (phrases > 0) & (level[start] >= k) & (level[np.maximum(start + phrases - (1 << k), 0)] >= k)


def _packed(parts: list[bytes]) -> bytes:
    sizes = np.array([len(d) for d in parts], "<u4")
    raw = np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts)
    return np.uint64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list[bytes]:
    raw = _ZSTD.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], "<u8")[0]), asbytes=True)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw[4:4 + 4 * n], "<u4").astype(np.int64))
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _packer(most_rows: int, most_bytes: int, part_batches: int):
    """Rows (part, nth, n_bytes, ids, anchors, body) of packed documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        ids: list[int | None] = []
        docs: list[bytes] = []
        size = 0

        def pack() -> pa.RecordBatch:
            known = np.array([i is not None for i in ids], np.uint8).tobytes()
            own = np.array([i or 0 for i in ids], "<i8").tobytes()
            at, start = anchors(docs)
            places = [np.diff(start, prepend=0).astype("<u4").tobytes(), (at - start).astype(np.uint8).tobytes()]
            return pa.RecordBatch.from_pydict({"part": [base + number // part_batches], "nth": [number], "n_bytes": [size],
                                               "ids": [own + known], "anchors": [_packed(places)], "body": [_packed(docs)]})

        for b in slices(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                docs.append(text or b"")
                size += len(docs[-1])
                if len(ids) >= most_rows or size >= most_bytes:
                    yield pack()
                    number, ids, docs, size = number + 1, [], [], 0
        if ids:
            yield pack()

    return work


_PACK_SQL = "part long, nth long, n_bytes long, ids binary, anchors binary, body binary"


def packs(docs: DataFrame, id_col: str, text_col: str, most_rows: int, most_bytes: int, part_batches: int) -> tuple[DataFrame, int]:
    """The packed documents as a table bucketed by part, in the shared folder,
    and their bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    name = f"packs_{uuid.uuid4().hex}"
    buckets = range_partitions(rows)
    # bodies are compressed already: a codec would only hold native buffers of a page, and a page by default all packs of a part
    rows.mapInArrow(_packer(most_rows, most_bytes, part_batches), _PACK_SQL).write.bucketBy(buckets, "part").sortBy("part", "nth") \
        .option("compression", "none").option("parquet.page.size.row.check.min", 1) \
        .option("path", scratch_dir(spark, name)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay, and ``table`` reads them
    return table, table.agg(F.sum("n_bytes")).first()[0] or 0


def _in_order(table: pa.Table) -> list[int]:
    return np.argsort(table["nth"].to_numpy(), kind="stable").tolist()


def _read(table: pa.Table, length: int) -> Iterator[tuple[int, Pack]]:
    """(nth, pack) of the packs of a part, one at a time."""
    for k in _in_order(table):
        step, ahead = _unpacked(table["anchors"][k].as_py())
        start = np.cumsum(np.frombuffer(step, "<u4").astype(np.int64))
        yield table["nth"][k].as_py(), Pack.of(_unpacked(table["body"][k].as_py()), length, start + np.frombuffer(ahead, np.uint8), start)


def _texts(table: pa.Table) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """(ids, documents) of the same packs."""
    for k in _in_order(table):
        ids, docs = table["ids"][k].as_py(), _unpacked(table["body"][k].as_py())
        n = len(docs)
        yield [i if known else None for i, known in zip(np.frombuffer(ids[:8 * n], "<i8").tolist(), ids[8 * n:], strict=True)], docs


def _counted(*columns: list[np.ndarray]) -> pd.DataFrame:
    """Distinct rows of columns (lists of pieces) with their counts."""
    df = pd.DataFrame({f"c{k}": np.concatenate(c) if c else np.zeros(0, np.int64) for k, c in enumerate(columns)})
    return df.groupby(list(df.columns), sort=False).size().reset_index(name="n")


def _pairs(part: int, first: list[np.ndarray], second: list[np.ndarray]) -> pa.Table:
    """Pairs of ranks of a part, each once."""
    c = _counted(first, second)
    return pa.table({"part": np.full(len(c), part), "nth": pa.nulls(len(c), pa.int64()), "body": pa.nulls(len(c), pa.binary()),
                     "r1": c["c0"].to_numpy(), "r2": c["c1"].to_numpy(), "n": c["n"].to_numpy()})


_STEP_SQL = "part long, nth long, body binary, r1 long, r2 long, n long"
_STATE = np.dtype([("k", "<i4"), ("at", "<i4"), ("end", "<i4"), ("rank", "<i8"), ("level", "<i1")])


def _phrase_pairs(length: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        found = [pack.phrases()[1] for _, pack in _read(table, length)]
        return _pairs(key[0].as_py(), found, [np.zeros(len(x), np.int64) for x in found])

    return work


def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs (r1, r2, part, n): those that occur twice, with the rank of
    their run. Ranks rise with the pairs' order in this range of them."""
    context = TaskContext.get()
    rank = (context.partitionId() if context else 0) << 40
    held: list[np.ndarray] = []

    def finished(r1, r2, part, n) -> pa.RecordBatch:
        nonlocal rank
        new = np.append(True, (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])) if len(r1) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        twice = (np.bincount(run, weights=n) > 1)[run] if len(r1) else new
        own = rank + 1 + run
        rank += int(new.sum())
        return pa.RecordBatch.from_arrays([pa.array(x[twice]) for x in (part, r1, r2, own)], names=["part", "r1", "r2", "rank"])

    for batch in batches:
        x = [batch.column(c).to_numpy() for c in ("r1", "r2", "part", "n")]
        if held:
            x = [np.concatenate((a, b)) for a, b in zip(held, x, strict=True)]
        if len(x[0]):
            last = (x[0] == x[0][-1]) & (x[1] == x[1][-1])  # its run may go on: at most one row of each part
            held = [v[last] for v in x]
            yield finished(*(v[~last] for v in x))
    if held:
        yield finished(*held)


def _ranks(pairs: DataFrame, tasks: int) -> DataFrame:
    """Sorted by rank pair; equal pairs share a task, at most one of each part."""
    return pairs.select("r1", "r2", "part", "n").repartition(tasks, "r1", "r2").sortWithinPartitions("r1", "r2") \
        .mapInArrow(reranked, "part long, r1 long, r2 long, rank long")


def _ranked(first: np.ndarray, second: np.ndarray, ranks: pd.DataFrame) -> np.ndarray:
    """The new ranks of pairs; 0 for those that occur once."""
    asked = pd.DataFrame({"r1": first, "r2": second})
    return asked.merge(ranks, on=["r1", "r2"], how="left")["rank"].fillna(0).to_numpy(np.int64) if len(asked) else np.zeros(0, np.int64)


def _next(part: int, states: list[tuple[int, np.ndarray]], offset: int, length: int) -> pa.Table:
    """The states' rows, and the pairs at ``offset`` of runs that are not past the threshold."""
    first, second = [], []
    for _, s in states:
        live = np.flatnonzero(s["rank"] > 0)
        other = np.searchsorted(s["k"], s["k"][live] + offset)
        ok = other < len(s)
        live, other = live[ok], other[ok]
        ok = (s["k"][other] == s["k"][live] + offset) & (s["rank"][other] > 0)
        live, other = live[ok], other[ok]
        tail = np.searchsorted(s["k"], s["k"][live] + 2 * offset - 1)  # the run's last phrase; alive, as part of it is
        ok = s["end"][tail] - s["at"][live] <= length
        first.append(s["rank"][live[ok]])
        second.append(s["rank"][other[ok]])
    rows = pa.table({"part": pa.array([part] * len(states), pa.int64()), "nth": pa.array([n for n, _ in states], pa.int64()),
                     "body": pa.array([s.tobytes() for _, s in states], pa.binary()), "r1": pa.nulls(len(states), pa.int64()),
                     "r2": pa.nulls(len(states), pa.int64()), "n": pa.nulls(len(states), pa.int64())})
    return pa.concat_tables([rows, _pairs(part, first, second)])


def _start(length: int):
    """The first ranks of a part's phrases."""
    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ranks, states = right.select(["r1", "r2", "rank"]).to_pandas(), []
        for nth, pack in _read(left, length):
            k, h = pack.phrases()
            rank = _ranked(h, np.zeros(len(h), np.int64), ranks)
            live = rank > 0
            s = np.zeros(int(live.sum()), _STATE)
            s["k"], s["at"], s["end"], s["rank"] = k[live], pack.at[k[live]], pack.at[k[live] + 1], rank[live]
            states.append((nth, s))
        return _next(key[0].as_py(), states, 1, length)

    return step


def _double(offset: int, length: int):
    """The ranks of runs of 2 * ``offset`` phrases from those of ``offset``."""
    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ranks, states = right.select(["r1", "r2", "rank"]).to_pandas(), []
        for nth, body in sorted(zip(left["nth"].to_pylist(), left["body"].to_pylist(), strict=True)):
            s = np.frombuffer(body, _STATE).copy()
            live = np.flatnonzero(s["rank"] > 0)
            other = np.searchsorted(s["k"], s["k"][live] + offset)
            ok = other < len(s)
            ok[ok] = s["k"][other[ok]] == s["k"][live[ok]] + offset
            found = np.zeros(len(live), np.int64)
            found[ok] = _ranked(s["rank"][live[ok]], s["rank"][other[ok]], ranks)
            s["rank"] = 0
            s["rank"][live] = found
            s["level"][live[found > 0]] += 1
            states.append((nth, s))
        return _next(key[0].as_py(), states, 2 * offset, length)

    return step


def _levels(pack: Pack, body: bytes | None) -> np.ndarray:
    level = np.full(len(pack.at) + 1, -1, np.int8)
    if body is not None:
        s = np.frombuffer(body, _STATE)
        level[s["k"]] = s["level"]
    return level


def _candidates(pack: Pack, level: np.ndarray) -> np.ndarray:
    """Anchors of which a window may occur twice."""
    k = np.flatnonzero(pack.low >= 0)
    return k[_shared(level, k, pack.need[k])]


def _core_rows(length: int):
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = dict(zip(right["nth"].to_pylist(), right["body"].to_pylist(), strict=True))
        cores, unions = [], []
        for nth, pack in _read(left, length):
            core, union = pack.cores(_candidates(pack, _levels(pack, bodies.get(nth))))
            cores.append(core)
            unions.append(union)
        c = _counted(cores, unions)
        return pa.table({"part": np.full(len(c), key[0].as_py()), "core": c["c0"].to_numpy(), "union": c["c1"].to_numpy(), "n": c["n"].to_numpy()})

    return work


def _verdicts(cores: DataFrame) -> DataFrame:
    """(part, core, union, settled, asked) of the rows that matter: ``settled``
    unions occur twice; the windows of ``asked`` ones are to be compared."""
    unions = cores.groupBy("core", "union").agg(F.sum("n").alias("total"), F.min("part").alias("who"))
    mixed = unions.groupBy("core").agg(F.count(F.lit(1)).alias("unions"), F.min("total").alias("least")) \
        .where("unions > 1 AND least = 1").select("core", F.lit(True).alias("mixed"))
    known = unions.join(mixed, "core", "left").where("total > 1 OR mixed") \
        .select("core", "union", (F.col("total") > 1).alias("settled"), F.coalesce("mixed", F.lit(False)).alias("mixed"), "who")
    return cores.join(known, ["core", "union"]) \
        .select("part", "core", "union", "settled", (F.col("mixed") & (F.col("part") == F.col("who"))).alias("asked")) \
        .where("settled OR asked")


def _distinct(high: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The distinct hashes (high, low) in order, with whether each occurs twice
    or some row of it says so, and each row's place among them."""
    if not len(high):
        return (high, low, many), np.zeros(0, np.int32)
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
    first = np.flatnonzero(new)
    twice = (np.diff(first, append=len(h)) > 1) | np.logical_or.reduceat(many[order], first)
    place = np.empty(len(h), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return (h[new], w[new], twice), place


@dataclass
class Asked:
    """What a pack knows: settled stretches, the windows it asks about, their
    distinct hashes, and each window's place among these."""

    settled: tuple[np.ndarray, np.ndarray]
    places: np.ndarray
    windows: tuple[np.ndarray, np.ndarray, np.ndarray]  # high, low, many
    index: np.ndarray


def _asked(pack: Pack, level: np.ndarray, verdicts: pd.DataFrame, length: int) -> Asked:
    k = _candidates(pack, level)
    core, union = pack.cores(k)
    own = pd.DataFrame({"core": core, "union": union}).merge(verdicts, on=["core", "union"], how="left")
    done, ask = own["settled"].eq(True).to_numpy(), own["asked"].eq(True).to_numpy()
    again = pd.Series(union).duplicated().to_numpy()  # of a union one member is enough
    ask = ask & ~again
    a, b = pack.low[k[ask]], pack.high[k[ask]] + 1
    size = b - a
    p = np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum())) if len(a) else a
    first = np.repeat(k[ask], size)
    p = p[_shared(level, first, pack.last(p) - first)]
    windows, index = _distinct(*pack.windows(p), np.zeros(len(p), bool))
    return Asked((pack.low[k[done]], pack.high[k[done]] + length), p, windows, index)


def _by_nth(info: pa.Table) -> tuple[dict[int, bytes], pd.DataFrame, list[tuple[int, bytes]]]:
    """A part's rows by kind: states (nth, body), verdicts, answers (bucket, bits)."""
    states = {r["nth"]: r["body"] for r in info.filter(pc.equal(info["kind"], 0)).select(["nth", "body"]).to_pylist()}
    verdicts = info.filter(pc.equal(info["kind"], 1)).select(["core", "union", "settled", "asked"]).to_pandas()
    answers = [(r["nth"], r["body"]) for r in info.filter(pc.equal(info["kind"], 2)).select(["nth", "body"]).to_pylist()]
    return states, verdicts, answers


def _prepared(left: pa.Table, info: pa.Table, length: int) -> tuple[list[Asked | None], tuple[np.ndarray, np.ndarray, np.ndarray], list]:
    """By pack, what it asks, with places among the part's distinct hashes; these; the answers."""
    states, verdicts, answers = _by_nth(info)
    asked = [_asked(pack, _levels(pack, states.get(nth)), verdicts, length) if len(verdicts) else None for nth, pack in _read(left, length)]
    known = [a for a in asked if a is not None]
    if not known:
        return asked, (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, bool)), answers
    windows, place = _distinct(*(np.concatenate(x) for x in zip(*(a.windows for a in known), strict=True)))
    at = 0
    for a in known:
        n = len(a.windows[0])
        a.index, a.windows = place[at:at + n][a.index], windows
        at += n
    return asked, windows, answers


def _bucket_of(high: np.ndarray, buckets: int) -> np.ndarray:
    return (high % np.uint64(buckets)).astype(np.int64)


def _questions(length: int, buckets: int):
    """Rows (bucket, part, body): a part's window hashes, 8 and 2 bytes and one
    for "twice here" each."""
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (high, low, many), out = _prepared(left, right, length)[1], ([], [])
        bucket = _bucket_of(high, buckets)
        for b in np.unique(bucket).tolist():
            at = bucket == b
            out[0].append(b)
            out[1].append(high[at].astype("<u8").tobytes() + low[at].astype("<u2").tobytes() + many[at].astype(np.uint8).tobytes())
        return pa.table({"bucket": pa.array(out[0], pa.int64()), "part": pa.array([key[0].as_py()] * len(out[0]), pa.int64()),
                         "body": pa.array(out[1], pa.binary())})

    return work


def _compared(key: tuple, table: pa.Table) -> pa.Table:
    """For each part's question the bits of the windows that occur twice."""
    high, low, many, sizes = [], [], [], []
    for body in table["body"]:
        raw = body.as_buffer()
        m = raw.size // 11
        high.append(np.frombuffer(raw, "<u8", m))
        low.append(np.frombuffer(raw, "<u2", m, 8 * m))
        many.append(np.frombuffer(raw, bool, m, 10 * m))
        sizes.append(m)
    (_, _, twice), place = _distinct(*(np.concatenate(x) for x in (high, low, many)))
    cuts = np.append(0, np.cumsum(sizes))
    return pa.table({"part": table["part"], "nth": pa.array([key[0].as_py()] * len(table), pa.int64()),
                     "body": pa.array([np.packbits(twice[place[a:b]]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _runs(marks: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [{"from": a, "to": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()),
                   ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])


def _finish(length: int, buckets: int):
    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        packs_asked, (high, _, _), answers = _prepared(left, right, length)
        twice = np.zeros(len(high), bool)
        bucket = _bucket_of(high, buckets)
        for b, bits in answers:
            at = np.flatnonzero(bucket == b)
            twice[at] = np.unpackbits(np.frombuffer(bits, np.uint8))[:len(at)] == 1
        out = []  # a batch for each pack, so that no more of a part's texts is sent at once
        for (ids, docs), asked in zip(_texts(left), packs_asked, strict=True):
            cuts = np.append(0, np.cumsum([len(d) for d in docs]))
            gone = np.zeros(int(cuts[-1]), bool)
            if asked is not None:
                p = asked.places[twice[asked.index]]
                a, b = np.concatenate((asked.settled[0], p)), np.concatenate((asked.settled[1], p + length))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1])) if len(a) else a
                for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist() if len(a) else []):
                    gone[x:y] = True
            marks = [gone[x:y] for x, y in zip(cuts, cuts[1:])]
            left_over = [np.frombuffer(d, np.uint8)[~g].tobytes() if g.any() else d for d, g in zip(docs, marks, strict=True)]
            columns = (ids, [len(d) for d in docs], left_over, [_runs(g) for g in marks])
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT, strict=True)], schema=_KEPT))
        return pa.Table.from_batches(out, schema=_KEPT)

    return work


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_rows: int = BATCH_ROWS,
         most_bytes: int = BATCH_BYTES, part_batches: int = PART_BATCHES) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row: the bytes left, and the
    maximal runs [from, to) of those removed. ``length`` is at least 2 *
    (GRAM + WINDOW - 1)."""
    if length < 2 * (GRAM + WINDOW - 1):
        raise ValueError("length must be at least 2 * (GRAM + WINDOW - 1)")
    spark = docs.sparkSession
    importable(spark)
    table, size = packs(docs, id_col, text_col, most_rows, most_bytes, part_batches)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 * BUCKET_BYTES))
    buckets = max(tasks, size // BUCKET_BYTES)
    parts = table.groupBy("part")

    ranks = _ranks(parts.applyInArrow(_phrase_pairs(length), _STEP_SQL), tasks)
    now = lineage_cut(parts.cogroup(ranks.groupBy("part")).applyInArrow(_start(length), _STEP_SQL))
    offset = 1
    while now.where("r1 IS NOT NULL").limit(1).count():
        ranks = _ranks(now.where("r1 IS NOT NULL"), tasks)
        now = lineage_cut(now.where("r1 IS NULL").groupBy("part").cogroup(ranks.groupBy("part"))
                          .applyInArrow(_double(offset, length), _STEP_SQL))
        offset *= 2
    state = now.where("r1 IS NULL").select("part", "nth", "body")

    cores = lineage_cut(parts.cogroup(state.groupBy("part")).applyInArrow(_core_rows(length), "part long, core long, union long, n long"))
    verdicts = lineage_cut(_verdicts(cores))

    def info(kind: int, df: DataFrame) -> DataFrame:
        given = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("nth", "body", "core", "union", "settled", "asked")}
        types = {"nth": "long", "body": "binary", "core": "long", "union": "long", "settled": "boolean", "asked": "boolean"}
        return df.select("part", F.lit(kind).alias("kind"), *(given[c].cast(t).alias(c) for c, t in types.items()))

    known = info(0, state).unionByName(info(1, verdicts))
    questions = parts.cogroup(known.groupBy("part")).applyInArrow(_questions(length, buckets), "bucket long, part long, body binary")
    answers = lineage_cut(questions.groupBy("bucket").applyInArrow(_compared, "part long, nth long, body binary"))
    return parts.cogroup(known.unionByName(info(2, answers)).groupBy("part")) \
        .applyInArrow(_finish(length, buckets), "doc_id long, n_bytes long, kept binary, spans array<struct<from: long, to: long>>")
