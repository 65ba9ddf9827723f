"""Packed token-id matrices by best-fit decreasing.

Documents are encoded, dealt by a hash of their id and text (so rows without
an id, or of one id, spread too) into packs of about
PACK_CHARS characters, and each pack is packed by itself: its documents, cut
into pieces of at most ``length`` tokens without loss, go from the longest to
the shortest into the row with the least room that still holds them. The rows'
room is indexed by a segment tree over the values 0 to ``length``, whose nodes
count the rows below; the search for the least room of at least n, and each
update, take logarithmic time.

``pack`` returns one row for each matrix row: pack, row, n_tokens, doc_ids and
parts (the pieces in their places, the part's number within its document),
cu_seqlens (0 and each piece's end), ids and positions (``length``
little-endian 32-bit integers each; positions start at 0 with every piece; the
rest is ``pad`` and 0). ``write`` stores them as Parquet, ``unpack`` gives the
documents' ids back.

Defined results: each document ends with ``end`` (None: without), so a null or
empty text is that one token (without: no piece at all). Rows that repeat an
id are pieces of their own; they keep apart by ``rows`` (a number within the
pack). Null ids are kept. Equal lengths go by id, then by text. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.bpe import read_ranks, vocabulary
from colorway.llm.common import importable, slices

LENGTH = 2048
PACK_CHARS = 4_000_000
BATCH_ROWS = 256



class Rooms:
    """Rows by their room: a segment tree over 0 to ``size`` that counts rows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``."""
        k, count = need + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up to the next subtree on the right that has rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of pieces: the pieces, in the order given, each into the fullest
    row that holds it."""
    rooms, rows = Rooms(size), []
    for piece, n in enumerate(lengths):
        found = rooms.take(n)
        if found is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        rooms.put(room - n, row)
    return rows


_ENCODERS: dict[tuple[bytes, str], Callable[[str], np.ndarray]] = {}


def library_encoder(content: bytes, pattern: str) -> Callable[[str], np.ndarray]:
    """The tokenizer's library; its ids are those of ``bpe``, as the tests of
    both compare."""
    import tiktoken
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _ENCODERS:
        of = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(content), special_tokens={})
        _ENCODERS[key] = lambda text: of.encode_to_numpy(text, disallowed_special=())
    return _ENCODERS[key]


_SCHEMA = pa.schema([
    ("pack", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("rows", pa.list_(pa.int32())), ("parts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("positions", pa.binary())])
_SQL = "pack long, row int, n_tokens int, doc_ids array<long>, rows array<int>, parts array<int>, cu_seqlens array<int>, " \
       "ids binary, positions binary"


def _matrix(pack: int, docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> Iterator[pa.RecordBatch]:
    pieces = [(doc, part, ids[at:at + length]) for doc, (_, ids) in enumerate(docs)
              for part, at in enumerate(range(0, len(ids), length))]
    pieces.sort(key=lambda p: -len(p[2]))  # stable: equal lengths stay in the documents' order
    rows = best_fit([len(p[2]) for p in pieces], length)
    for start in range(0, len(rows), BATCH_ROWS):
        out: list[list] = [[] for _ in _SCHEMA]
        for k, row in enumerate(rows[start:start + BATCH_ROWS], start):
            chosen = [pieces[p] for p in row]
            ends = np.cumsum([len(c[2]) for c in chosen])
            ids, positions = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
            for (_, _, c), end in zip(chosen, ends.tolist(), strict=True):
                ids[end - len(c):end] = c
                positions[end - len(c):end] = np.arange(len(c))
            for o, v in zip(out, (pack, k, int(ends[-1]), [docs[c[0]][0] for c in chosen], [c[0] for c in chosen],
                                  [c[1] for c in chosen], [0, *ends.tolist()], ids.tobytes(), positions.tobytes()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end: int | None = 50256, pad: int = 50256,
         id_col: str = "doc_id", text_col: str = "text", pack_chars: int = PACK_CHARS) -> DataFrame:
    """The packed matrix rows of all documents (see above)."""
    spark = docs.sparkSession
    importable(spark)
    content = vocabulary(spark, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    packs = 1 + chars // pack_chars
    tasks = min(packs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(content.value, pattern)
        tail = np.array([] if end is None else [end], "<u4")
        current, held = None, []
        for batch in slices(batches):
            for number, doc, text in zip(*(batch.column(c).to_pylist() for c in ("pack", "doc_id", "text")), strict=True):
                if number != current:
                    if held:
                        yield from _matrix(current, held, length, pad)
                    current, held = number, []
                held.append((doc, np.concatenate((encode(text), tail))))
        if held:
            yield from _matrix(current, held, length, pad)

    return rows.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs))) \
        .repartition(tasks, "pack").sortWithinPartitions("pack", "doc_id", "text").mapInArrow(work, _SQL)


def write(packed: DataFrame, folder: str) -> None:
    """The matrix as Parquet files: binary rows of ids and positions, with
    cumulative segment lengths."""
    packed.write.mode("overwrite").parquet(folder)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids): every document's ids in one piece again."""
    piece = F.explode(F.arrays_zip("doc_ids", "rows", "parts", F.slice("cu_seqlens", 1, F.size("parts")).alias("low"),
                                   F.slice("cu_seqlens", 2, F.size("parts")).alias("high")))
    cut = packed.select("pack", "ids", piece.alias("p")).select(
        "pack", F.col("p.doc_ids").alias("doc_id"), F.col("p.rows").alias("number"), F.col("p.parts").alias("part"),
        F.expr("substring(ids, 4 * p.low + 1, 4 * (p.high - p.low))").alias("ids"))
    # a document's pieces: as many as its own length gives
    return cut.groupBy("pack", "number", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("x")) \
        .select("doc_id", F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
