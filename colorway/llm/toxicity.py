"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

A text's features are its distinct words, pairs of neighbouring words and
pairs with one word skipped between them, each hashed to one of 2**BITS
coordinates. FTRL-proximal keeps per coordinate a gradient sum z and a sum of
squared gradients n, from which follow its own learning rate and, by the L1
term, a weight of exactly zero for coordinates without a clear signal. The
weights left are few, and go to all tasks as a broadcast of at most 2**BITS
entries (12 bytes each).

Learning takes a bounded sample of the labelled rows: at most POSITIVES
positive rows and RATIO negative ones for each, those with the smallest hash
of their id, among the labels that have a document. Their features are made
where the texts are read, so no text is shuffled. FTRL learns one row after the other, in the order of another
hash, so one task learns from these at most POSITIVES * (1 + RATIO) rows.
Positives weigh more in the sample than among all labels: the intercept leans
towards finding them. Scoring covers every row and every whole text.

Defined results: null and empty texts score 0. Repeated rows score alike, a
null id stays, and null labels are not learned from. Without labels of both
classes every text scores 0.5 (only that class: 1 or 0). Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, slices, texts
from colorway.llm.quality import held_out

BITS = 20
POSITIVES, RATIO = 5_000, 4
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
WORDS_KEPT = 150_000

_MASK = np.uint64((1 << BITS) - 1)
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGE = ".,;:!?*#$%&|<>\"'()[]{}-_"
_words: dict[str, int] = {}


def _hash(word: str) -> int:
    if len(_words) >= WORDS_KEPT:
        _words.clear()
    out = _words[word] = xxhash.xxh64_intdigest(word.lower().strip(_EDGE))
    return out


def features(text: str) -> np.ndarray:
    """The distinct coordinates of a text, ascending."""
    words = text.split()
    known = _words.get
    h = np.array([known(w) or _hash(w) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _PAIR) ^ (h[1:] >> np.uint64(7))
        skips = (h[:-2] * _SKIP) ^ (h[2:] >> np.uint64(9))
        every = np.concatenate((h, pairs * _SKIP, skips * _PAIR))
        return np.unique((every ^ (every >> np.uint64(32))) & _MASK).astype(np.uint32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, squared gradients, intercept) after the rows in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = squares = 0.0
    for _ in range(epochs):
        for x, label in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + math.exp(min(max(-(bias + w.sum()), -35), 35)))
            g = p - label
            z[x] += g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] += g * g
            squares += g * g
            bias -= ALPHA / (BETA + math.sqrt(squares)) * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, n, bias


def sample(labels: DataFrame, positives: int = POSITIVES, ratio: int = RATIO) -> DataFrame:
    """Of (doc_id, label): of each class the rows with the smallest id hashes,
    at most ``positives`` and ``ratio`` times as many of the other class."""
    shares = {r["label"]: r["count"] for r in labels.where("label IN (0, 1)").groupBy("label").count().collect()}
    most = min(shares.get(1, 0), positives)

    def of(value: int, n: int) -> DataFrame:
        return labels.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    return of(1, positives).unionByName(of(0, ratio * (most or positives)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, intercept), learned from ``docs`` (doc_id, text)
    and ``labels`` (doc_id, label)."""
    importable(docs.sparkSession)
    present = labels.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    chosen = F.broadcast(sample(present))  # at most POSITIVES * (1 + RATIO) rows
    rows = docs.join(chosen, "doc_id").where("text IS NOT NULL") \
        .select(F.lit(0).alias("one"), F.xxhash64("doc_id", F.lit(2)).alias("order"), "doc_id", "text", "label")
    schema = pa.schema([("one", pa.int32()), ("order", pa.int64()), ("doc_id", pa.int64()), ("x", pa.binary()), ("label", pa.int32())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([features(t).astype("<u4").tobytes() for t in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("order"), batch.column("doc_id"), x,
                                              batch.column("label").cast(pa.int32())], schema=schema)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
        data = [(np.frombuffer(x, "<u4"), y) for x, y in zip(table["x"].to_pylist(), table["label"].to_pylist(), strict=True)]
        found = {y for _, y in data}
        w, _, bias = ftrl(data) if len(found) > 1 else (np.zeros(0), None, 700.0 if 1 in found else -700.0)
        at = np.flatnonzero(w)
        return pa.table({"at": np.append(at, -1), "w": np.append(w[at], bias)})

    rows = rows.mapInArrow(made, "one int, order long, doc_id long, x binary, label int")
    model = rows.groupBy("one").applyInArrow(learn, "at long, w double").toArrow()  # at most 2**BITS + 1 rows
    at, w = model["at"].to_numpy(), model["w"].to_numpy()
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, learned
    from the labelled rows that are not held out."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where(~held_out(F.col("doc_id")))
    at, w, bias = fit(rows, known)
    model = spark.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[model.value[0]] = model.value[1]
        for batch in slices(batches):
            scores = np.array([1 / (1 + math.exp(min(max(-(bias + weights[features(t)].sum()), -700), 700)))
                               if t and not t.isspace() else 0.0 for t in texts(batch)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= cutoff).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(work, "doc_id long, score double, predicted int") \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
