"""Substring removal with suffix automata of reference shards.

A word goes if it lies in a window of LENGTH words that also starts in a
document with a smaller id. The windows are found in four steps:

1. Documents are packed into batches. In each, every window picks an anchor,
   the smallest hash of the RUN-word runs in it, so equal windows pick equal
   anchors, and only about one word in five is one. For each bucket of anchors
   a batch sends its distinct anchors with the smallest document of each.
2. A bucket finds the anchors that occur in two documents, the first document
   of each, and answers the batches that asked.
3. Each batch cuts the stretches of words around such anchors from its
   documents. A stretch goes to the reference shard of the first document of
   its anchors; so all equal windows meet in one shard.
4. A shard takes its stretches in the order of ids. It streams a document's
   stretches through the suffix automaton of what smaller documents brought:
   where the matching statistic is LENGTH or more, a window ends that occurred
   before. Then what was new in them is added to the automaton. So the
   automaton holds every passage once, however often it is repeated.

The results go back to the batches, which return each document's kept words.
Anchors only propose and route; what is removed, the automaton has matched
word by word.

Skew: a batch sends one entry for an anchor however many of its documents have
it. The windows around an anchor that more than SPLIT documents have do not go
to a shard: their words are hashed (128 bits) and each hash's smallest
document is found by an aggregate and a join on hashes, which Spark combines
and splits; so a common phrase in ever other contexts meets nothing. A shard
thus holds at most SPLIT stretches for each anchor of its first document.
Memory: a task holds one batch (at most BATCH_ROWS documents, or BATCH_CHARS
characters and one document), or one bucket's entries, or the stretches and
automaton of one shard.

The method calls for broadcast automata of reference shards. Automata of a
whole corpus cannot be broadcast, so each shard's automaton stays in its task
and the anchors bring it the stretches that can match.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null texts have
none. Rows of one id never remove words from each other. A null id counts as
larger than all others. Every row of the input gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut, slices, unused

LENGTH = 13
RUN = 5
BATCH_ROWS, BATCH_CHARS = 512, 2_000_000
DOCS_PER_BUCKET = 4_000
SPLIT = 4_000
WORDS_KEPT = 150_000
_NULL = (1 << 63) - 1
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)

_ZSTD = pa.Codec("zstd", compression_level=5)
_words: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    if len(_words) >= WORDS_KEPT:
        _words.clear()
    out = _words[word] = xxhash.xxh64_intdigest(word)
    return out


def _spread(x: np.ndarray, n: int, better: Callable) -> np.ndarray:
    """Running minimum or maximum of n neighbours from each place on."""
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = better(out[:len(out) - step], out[step:])
        done += step
    return out


def anchors(docs: list[list[bytes]], length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash) of the anchors of lists of words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if total < length:
        return none
    known = _words.get
    h = np.array([known(w) or _hash(w) for d in docs for w in d], np.uint64)
    runs = np.zeros(total - run + 1, np.uint64)
    for k in range(run):
        runs = (runs + h[k:k + len(runs)]) * _C
    runs = (runs ^ (runs >> np.uint64(30))) * _A
    runs ^= runs >> np.uint64(31)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(total)
    reach = length - run + 1
    low = _spread(runs, reach, np.minimum)  # by window
    low[at[:len(low)] + length > ends[:len(low)]] = 0  # not a window of one document
    pad = np.zeros(reach - 1, np.uint64)
    high = _spread(np.concatenate((pad, low, pad)), reach, np.maximum)  # by run
    places = np.flatnonzero((runs == high) & (high > 0))
    doc = np.repeat(np.arange(len(docs)), sizes)[places]
    return doc, places - (np.cumsum(sizes) - sizes)[doc], runs[places] >> np.uint64(16)


def _short(hashes: np.ndarray) -> bytes:
    """48-bit hashes as 6 bytes each. (Anchors only propose; a chance meeting
    costs time but removes nothing.)"""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Automaton:
    """Suffix automaton of the word lists added to it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
            else:
                new = -1  # the state exists, but must be split
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p < 0:
                last = new
                continue
            q = nxt[p][w]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                q = clone
            if new >= 0:
                link[new] = q
                last = new
            else:
                last = q

    def matched(self, words: list[int], length: int) -> np.ndarray:
        """For each word whether ``length`` words that end in it were added."""
        nxt, link, lengths = self.next, self.link, self.length
        state = n = 0
        out = np.zeros(len(words), bool)
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = lengths[state]
                to = nxt[state].get(w)
            if to is not None:
                state = to
                n += 1
                if n >= length:
                    out[i] = True
        return out


def _covered(ends: np.ndarray, length: int) -> np.ndarray:
    """The words of windows that end at the marked words."""
    out = np.zeros(len(ends) + length, np.int64)
    at = np.flatnonzero(ends)
    np.add.at(out, at - length + 1, 1)
    np.add.at(out, at + 1, -1)
    return np.cumsum(out)[:len(ends)] > 0


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the stretches of marked places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _shard(stretches: list[tuple], length: int) -> Iterator[tuple[tuple, list[tuple[int, int]]]]:
    """For stretches (id, ..., words as bytes last) of one first document:
    each with the spans of words that smaller documents have too."""
    ids: dict[bytes, int] = {}
    automaton = Automaton()
    seen: dict[bytes, int] = {}
    stretches.sort(key=lambda s: (s[0], s[-1]))
    start = 0
    while start < len(stretches):
        end = start
        while end < len(stretches) and stretches[end][0] == stretches[start][0]:
            end += 1
        fresh = []
        for s in stretches[start:end]:
            text = s[-1]
            words = text.split()
            if seen.get(text, s[0]) < s[0]:  # a smaller document had the very same stretch
                yield s, [(0, len(words))]
                continue
            seen.setdefault(text, s[0])
            coded = [ids.setdefault(w, len(ids)) for w in words]
            ends = automaton.matched(coded, length)
            fresh += [coded[a:b + length - 1] for a, b in _runs(~ends[length - 1:])]
            yield s, _runs(_covered(ends, length))
        for words in fresh:
            automaton.add(words)
        start = end


def _packed(docs: list[bytes]) -> bytes:
    sizes = np.array([len(d) for d in docs], "<u4")
    raw = np.uint32(len(docs)).tobytes() + sizes.tobytes() + b"".join(docs)
    return np.uint32(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list[bytes]:
    raw = _ZSTD.decompress(blob[4:], decompressed_size=int(np.frombuffer(blob[:4], "<u4")[0]), asbytes=True)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw[4:4 + 4 * n], "<u4").astype(np.int64))
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _batches(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 1: per batch a row with its ids and packed texts (bucket -1), and
    one for each bucket with its anchors, their smallest documents and how
    many of the batch's documents have them."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("body", pa.binary())])

    def batch(number: int, ids: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        doc, _, hashes = anchors([b.split() for b in bodies], length)
        own = np.array(ids, np.int64)
        order = np.lexsort((own[doc], hashes))
        h, d = hashes[order], own[doc][order]
        once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
        h, d = h[once], d[once]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(first, len(h))), 65535).astype("<u2")
        h, d = h[first], d[first]
        bucket = h % np.uint64(buckets)
        out: tuple[list, list, list, list] = ([-1], [number], [own.astype("<i8").tobytes()], [_packed(bodies)])
        table, index = np.unique(d, return_inverse=True)
        index = index.astype("<u2")
        for k in np.unique(bucket).tolist():
            at = bucket == k
            used, place = np.unique(index[at], return_inverse=True)
            out[0].append(k)
            out[1].append(number)
            out[2].append(_packed([table[used].astype("<i8").tobytes(), count[at].tobytes()]))
            out[3].append(_short(h[at]) + place.astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids: list[int] = []
        bodies: list[bytes] = []
        chars = 0
        for b in slices(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(_NULL if i is None else i)
                bodies.append(text or b"")
                chars += len(bodies[-1])
                if len(ids) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(number, ids, bodies)
                    number, ids, bodies, chars = number + 1, [], [], 0
        if ids:
            yield batch(number, ids, bodies)

    return docs.mapInArrow(work, "bucket int, batch long, ids binary, body binary")


def _answers(table: pa.Table, split: int) -> pa.Table:
    """Step 2: for each batch, its anchors that two documents have, with the
    first document and whether more than ``split`` have it."""
    h, d, c, who = [], [], [], []
    batches = table["batch"].to_pylist()
    for k, (ids, body) in enumerate(zip(table["ids"].to_pylist(), table["body"].to_pylist())):
        n = len(body) // 8
        own, count = _unpacked(ids)
        h.append(_long(body[:6 * n]))
        d.append(np.frombuffer(own, "<i8")[np.frombuffer(body[6 * n:], "<u2")])
        c.append(np.frombuffer(count, "<u2").astype(np.int64))
        who.append(np.full(n, k, np.int32))
    h, d, c, who = (np.concatenate(x) for x in (h, d, c, who))
    order = np.argsort(h, kind="stable")
    h, d, c, who = h[order], d[order], c[order], who[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(start, len(h)))
    first, total = np.minimum.reduceat(d, start), np.add.reduceat(c, start)
    last = np.maximum.reduceat(d, start)
    repeated = np.repeat((last > first) | (total > sizes), sizes)
    shards = np.where(total > split, 2, 1)
    h, who = h[repeated], who[repeated]
    first, shards = np.repeat(first, sizes)[repeated], np.repeat(shards, sizes)[repeated]
    order = np.lexsort((h, who))
    h, who, first, shards = h[order], who[order], first[order], shards[order]
    cuts = np.searchsorted(who, np.arange(len(batches) + 1))
    out: tuple[list, list, list] = ([], [], [])
    for k, number in enumerate(batches):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if b > a:
            out[0].append(number)
            out[1].append(_short(h[a:b]) + _packed([first[a:b].astype("<i8").tobytes(), shards[a:b].astype("<u2").tobytes()]))
            out[2].append(b - a)
    return _table({"batch": (out[0], pa.int64()), "answer": (out[1], pa.binary()), "n": (out[2], pa.int64())})


def _stretches(packed: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    """Step 3: (first, shard, id, batch, row, at, words) of a batch; shard 0 has
    hashes of windows around common anchors: the largest id as first, the
    smallest as id, and hash and places as words."""
    rows: dict[str, list] = {k: [] for k in ("first", "shard", "id", "batch", "row", "at", "words")}
    if len(packed) and len(answers):
        parts = list(zip(answers["answer"].to_pylist(), answers["n"].to_pylist()))
        h = np.concatenate([_long(p[:6 * k]) for p, k in parts])
        rest = [_unpacked(p[6 * k:]) for p, k in parts]
        f = np.concatenate([np.frombuffer(r[0], "<i8") for r in rest])
        s = np.concatenate([np.frombuffer(r[1], "<u2") for r in rest])
        order = np.argsort(h)
        h, f, s = h[order], f[order], s[order]
        number = packed["batch"][0].as_py()
        ids = np.frombuffer(packed["ids"][0].as_py(), "<i8").tolist()
        docs = [b.split() for b in _unpacked(packed["body"][0].as_py())]
        doc, place, hashes = anchors(docs, length)
        at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
        known = h[at] == hashes
        doc, place, at = doc[known], place[known], at[known]
        first, common = f[at], s[at] > 1

        def add(*values) -> None:
            for key, value in zip(rows, values, strict=True):
                rows[key].append(value)

        # windows around common anchors: each hash once, with its places in this batch
        seen = np.unique(np.concatenate([doc[common] << 32 | np.maximum(place[common] - k, 0) for k in range(length - RUN + 1)]))
        places: dict[bytes, list[int]] = {}
        for at_ in seen.tolist():
            k, p = at_ >> 32, at_ & 0xFFFFFFFF
            if p + length <= len(docs[k]):
                places.setdefault(xxhash.xxh3_128_digest(b" ".join(docs[k][p:p + length])), []).append(at_)
        for digest, held in places.items():
            own = [ids[x >> 32] for x in held]
            add(max(own), 0, min(own), number, 0, 0, digest + np.array(held, "<u8").tobytes())
        doc, place, first = doc[~common], place[~common], first[~common]
        # neighbouring anchors of one first document make one stretch
        new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (place[1:] - place[:-1] > length)) if len(doc) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(doc))[:len(starts)].tolist()):
            k = int(doc[a])
            low = max(0, int(place[a]) - (length - RUN))
            add(int(first[a]), 1, ids[k], number, k, low, b" ".join(docs[k][low:int(place[b - 1]) + length]))
    return _table({k: (v, pa.binary() if k == "words" else pa.int64()) for k, v in rows.items()})


_STRETCH = "first long, shard long, id long, batch long, row long, at long, words binary"


def _matches(table: pa.Table, length: int) -> pa.Table:
    """Step 4: rows (batch, row, at, to) of words found; the hashes of shard 0
    go on as they are, with their smallest and largest id and places."""
    rows: dict[str, list] = {k: [] for k in ("id", "most", "batch", "row", "at", "to", "hash", "places")}

    def add(*values) -> None:
        for key, value in zip(rows, values, strict=True):
            rows[key].append(value)

    groups: dict[int, list[tuple]] = {}
    for first, shard, *rest in zip(*(table[k].to_pylist() for k in ("first", "shard", "id", "batch", "row", "at", "words")), strict=True):
        if shard:
            groups.setdefault(first, []).append(tuple(rest))
        else:
            i, batch, _, _, held = rest
            add(i, first, batch, None, None, None, held[:16], held[16:])
    while groups:
        _, stretches = groups.popitem()
        for (i, batch, row, at, _), found in _shard(stretches, length):
            for a, b in found:
                add(i, None, batch, row, at + a, at + b, None, None)
    return _table({k: (v, pa.binary() if k in ("hash", "places") else pa.int64()) for k, v in rows.items()})


_MATCH = "id long, most long, batch long, row long, at long, to long, hash binary, places binary"


def _kept(packed: pa.Table, spans: pa.Table, length: int) -> Iterator[tuple[int | None, bytes, list[bytes], np.ndarray]]:
    """(id, text, words, which stay) of a batch's documents."""
    if not len(packed):
        return
    ids = np.frombuffer(packed["ids"][0].as_py(), "<i8").tolist()
    bodies = _unpacked(packed["body"][0].as_py())
    docs = [b.split() for b in bodies]
    sizes = [len(d) for d in docs]
    base = np.cumsum([0, *sizes])
    gone = np.zeros(int(base[-1]) + 1, np.int64)
    known = spans.filter(pc.is_valid(spans["row"])) if len(spans) else spans
    if len(known):
        row, at, to = (known[k].to_numpy() for k in ("row", "at", "to"))
        np.add.at(gone, base[row] + at, 1)
        np.add.at(gone, base[row] + to, -1)
    common = spans.filter(pc.is_valid(spans["places"])).select(["low", "places"]) if len(spans) else spans
    if len(common):
        held = common["places"].to_pylist()
        place = np.frombuffer(b"".join(held), "<u8").astype(np.int64)
        row, at = place >> 32, place & 0xFFFFFFFF
        later = np.repeat(common["low"].to_numpy(), [len(h) // 8 for h in held]) < np.array(ids, np.int64)[row]
        np.add.at(gone, base[row[later]] + at[later], 1)
        np.add.at(gone, base[row[later]] + at[later] + length, -1)
    stays = np.cumsum(gone)[:-1] == 0
    for k, words in enumerate(docs):
        yield None if ids[k] == _NULL else ids[k], bodies[k], words, stays[base[k]:base[k + 1]]


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, split: int, finish: Callable[[Iterator], pa.Table], schema: str) -> DataFrame:
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    buckets = 1 + rows.select("doc_id").count() // DOCS_PER_BUCKET
    first = lineage_cut(_batches(rows, buckets, length))
    packed = first.where("bucket < 0").select("batch", "ids", "body")
    answers = first.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: _answers(t, split), "batch long, answer binary, n long")
    stretches = packed.groupBy("batch").cogroup(answers.groupBy("batch")) \
        .applyInArrow(lambda a, b: _stretches(a, b, length), _STRETCH)
    # several first documents share a task; windows of common anchors only pass through, spread over all
    own = F.when(F.col("shard") == 0, F.pmod(F.xxhash64("batch", "row"), F.lit(16 * buckets))) \
        .otherwise(F.pmod(F.xxhash64("first"), F.lit(16 * buckets)))
    found = lineage_cut(stretches.withColumn("task", own).groupBy("task").applyInArrow(lambda t: _matches(t, length), _MATCH))
    # a batch has one row for a hash, however many of its documents have it
    low = found.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("low"), F.max("most").alias("high")) \
        .where("low < high").select("hash", "low")
    again = found.where("hash IS NOT NULL").join(low, "hash").where("low < most").select("batch", "low", "places")
    spans = found.where("hash IS NULL").select("batch", "row", "at", "to").unionByName(again, allowMissingColumns=True)
    return packed.groupBy("batch").cogroup(spans.groupBy("batch")) \
        .applyInArrow(lambda a, b: finish(_kept(a, b, length)), schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            split: int = SPLIT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def finish(rows: Iterator) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, _, words, stays in rows:
            n = int(stays.sum())
            kept = words if n == len(words) else [words[k] for k in np.flatnonzero(stays).tolist()]
            for o, v in zip(out, (i, len(words), len(words) - n, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                o.append(v)
        return _table({"doc_id": (out[0], pa.int64()), "n_words": (out[1], pa.int64()),
                       "n_removed": (out[2], pa.int64()), "kept_sha256": (out[3], pa.string())})

    return _apply(docs, id_col, text_col, length, split, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            split: int = SPLIT) -> DataFrame:
    """(doc_id, text_hash, spans): the spans [from, to) of words to remove,
    for the rows that have any. text_hash is ``xxhash64`` of the text."""

    def finish(rows: Iterator) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for i, text, _, stays in rows:
            if not stays.all():
                hashed = xxhash.xxh64_intdigest(text, seed=42)  # as Spark's function
                for o, v in zip(out, (i, hashed - (hashed >> 63 << 64), [{"from": a, "to": b} for a, b in _runs(~stays)]), strict=True):
                    o.append(v)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return _table({"doc_id": (out[0], pa.int64()), "text_hash": (out[1], pa.int64()), "spans": (out[2], kind)})

    return _apply(docs, id_col, text_col, length, split, finish, "doc_id long, text_hash long, spans array<struct<from: long, to: long>>")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars",
            length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """``docs`` with all columns; a text with words to remove becomes the words
    kept, joined by spaces, and ``size_col`` (if there) its length."""
    own, marked, gone = unused(docs, "own_id", "text_hash", "spans")
    found = removed(docs, id_col, text_col, length, split).dropDuplicates(["doc_id", "text_hash"]) \
        .select(F.col("doc_id").alias(own), F.col("text_hash").alias(marked), F.col("spans").alias(gone))
    joined = docs.join(found, docs[id_col].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(marked)), "left")
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists(gone, lambda s: (i >= s["from"]) & (i < s["to"])))
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, " ")))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(gone).isNull(), F.col(size_col))
                             .otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out.select(docs.columns)
