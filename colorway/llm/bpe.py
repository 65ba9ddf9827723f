"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut into pieces by the tokenizer's pattern; every piece is merged
on its own. A segment tree over the piece's byte positions holds, at each
leaf, the rank of the pair that starts there, and at the root the leftmost
pair of the lowest rank. A merge changes at most three leaves (the pair that
went, its left neighbour, its right neighbour), each in logarithmic time, so
a piece of n bytes costs O(n log n) also when it is one very long word.

Null and empty texts give no ids. Rows are independent: repeated rows, null
ids and ties have no influence on each other. Whole texts are encoded; there
is no length limit. Only the named columns are read, so other columns of the
input may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.llm.common import arrow_rows, importable, slices, texts

#: Words and pieces a Python worker remembers (about 130 MB); then it starts afresh.
WORDS_KEPT, PIECES_KEPT = 200_000, 500_000
#: Longer ones are not remembered.
LENGTH_KEPT = 48


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    m = n - 1  # pair positions
    none = len(ranks) * n + n
    tree = [none] * (2 * m)
    for i in range(m):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[m + i] = rank * n + i  # the smallest key: lowest rank, then leftmost
    for k in range(m - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(leaf: int, key: int) -> None:
        k = m + leaf
        tree[k] = key
        while k > 1:
            other = tree[k ^ 1]
            low = key if key < other else other
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = key = low

    while (best := tree[1]) < none:
        i = best % n
        j = after[i]
        end = after[j]
        after[i] = end
        if j < m:
            put(j, none)
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i:after[end]])
            put(i, none if rank is None else rank * n + i)
        else:
            put(i, none)
        if i:
            h = before[i]
            rank = ranks.get(piece[h:end])
            put(h, none if rank is None else rank * n + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary, kept by a Python worker."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers."""
        out = self.merged.get(text)
        if out is None:
            ids = merge_piece(text.encode(), self.ranks)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= LENGTH_KEPT:
                if len(self.merged) >= PIECES_KEPT:
                    self.merged.clear()
                self.merged[text] = out
        return out

    def word(self, text: str) -> bytes:
        parts = self.pieces(text)
        out = self.piece(text) if len(parts) == 1 else b"".join([self.piece(p) for p in parts])
        if len(text) <= LENGTH_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """Where single spaces and line ends are the only white space, the
        pattern always starts a piece at a space and around a line end, so
        each word with its leading space is encoded by itself and remembered.
        Other texts are cut by the pattern as a whole."""
        chunks: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                chunks.append("\n")
            chunks += line.replace(" ", "\0 ").split("\0")
        if len(text.split()) != len(chunks) - text.count("\n") or "\0" in text:
            return b"".join([self.piece(p) for p in self.pieces(text)])
        known, word = self.words.get, self.word
        return b"".join([known(c) or word(c) for c in chunks])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (fixed size, about 1 MB) as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian 32-bit integers, n_tokens)."""
    return _map(docs, path, pattern, id_col, text_col, {"ids": pa.binary(), "n_tokens": pa.int64()},
                lambda c, t: (ids := c.encode(t), len(ids) // 4))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ``encode``'s ids; bytes that are no UTF-8 are replaced."""
    spark = encoded.sparkSession
    importable(spark)
    content = vocabulary(spark, path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = pa.schema([("doc_id", _kind(rows)), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value, pattern)
        for batch in slices(batches):
            out = [c.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield arrow_rows({"doc_id": batch.column("doc_id").to_pylist(), "text": out}, schema)

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string") \
        .withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes
    the ids again, and returns what shows both."""

    def digests(c: Codec, text: str) -> tuple:
        ids = c.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _map(docs, path, pattern, id_col, text_col,
                {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, digests)


def _kind(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(rows.schema["doc_id"].dataType)


_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def _map(docs, path, pattern, id_col, text_col, columns, each) -> DataFrame:
    spark = docs.sparkSession
    importable(spark)
    content = vocabulary(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", _kind(rows)), *columns.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value, pattern)
        for batch in slices(batches):
            got = [each(c, t) for t in texts(batch)]
            out = {"doc_id": batch.column("doc_id").to_pylist()}
            out |= {name: [g[k] for g in got] for k, name in enumerate(columns)}
            yield arrow_rows(out, schema)

    sql = ", ".join(f"{name} {_SQL[kind]}" for name, kind in columns.items())
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {sql}") \
        .withColumnRenamed("doc_id", id_col)
