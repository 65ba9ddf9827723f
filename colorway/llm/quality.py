"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (logarithms of counts,
arcsine square roots of shares). Per class, counts, sums and cross products of
the labelled rows' vectors are summed by Spark (they add up, so partial sums
are combined before the shuffle, and all labelled rows take part). From them
come the class means and covariances. A covariance is shrunk towards the
pooled one and then towards a scaled identity, so that it is positive definite
also with few rows or constant statistics. Its Cholesky factor is computed
once; a row's score is the logistic of

    log prior1/prior0 + log N(x; m1, S1) - log N(x; m0, S0)

over a temperature, with Mahalanobis distances from the cached factors.

Defined results: null and empty texts (no word) score 0. A score is added up
in a fixed order of the statistics, whatever else its batch holds, and the
moments are sums of whole numbers (UNIT), whatever the partitions: so equal
texts get equal scores. A null id is kept. Labels that are null are not learned from; a label row that occurs twice counts twice.
With labels of one class only, every text with a word scores that class; with
none, 0.5. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut, slices, texts

STATISTICS = ("words", "word length", "long words", "upper case", "digits", "marks", "exclamation", "periods",
              "commas", "other signs", "distinct words", "commonest word", "distinct runs", "distinct lines",
              "line length", "short lines", "capital starts")
SIZE = len(STATISTICS)
#: Moments are counted in these units: a row adds at most about 2**28 to a sum.
UNIT = 2.0 ** -20
_MARKS, _SIGNS = b"#*$%&|<>", b"@=+_~^\\{}[]()/;:-\"'"


def statistics(text: str) -> list[float]:
    """The statistics of one text, before their transformation."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * SIZE
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    chars = max(1, sum(map(len, words)))
    runs = max(1, n - 3)
    return [
        n, chars / n, sum(c for w, c in counts.items() if len(w) > 14) / n,
        seen[65:91].sum() / letters, seen[48:58].sum() / chars, sum(int(seen[c]) for c in _MARKS) / chars,
        (seen[33] + seen[63]) / n, seen[46] / n, seen[44] / n, sum(int(seen[c]) for c in _SIGNS) / chars,
        len(counts) / n, max(counts.values()) / n,
        len(set(zip(words, words[1:], words[2:], words[3:]))) / runs if n > 3 else 1.0,
        len(set(lines)) / len(lines), n / len(lines), sum(len(x) < 40 for x in lines) / len(lines),
        sum(c for w, c in counts.items() if w[0].isupper()) / n,
    ]


_LOGS = [0, 1, 14]


def transformed(x: np.ndarray) -> np.ndarray:
    """Logarithms of sizes, arcsine square roots of shares."""
    out = np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    out[:, _LOGS] = np.log1p(x[:, _LOGS])
    return out


@dataclass(frozen=True)
class Moments:
    """Count, sum and cross products of a class."""

    n: int
    total: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def scatter(self) -> np.ndarray:
        return self.products - np.outer(self.total, self.total) / self.n


def _distance(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows times a lower triangular factor. Columns are
    added one after the other: the order of a matrix product's additions
    depends on a row's place in the batch."""
    out = np.zeros(len(x))
    for i in range(SIZE):
        y = np.zeros(len(x))
        for j in range(i + 1):
            y += factor[i, j] * x[:, j]
        out += y * y
    return out


@dataclass(frozen=True)
class Model:
    """Per class: log prior less half the log determinant, mean, and the
    inverse of the covariance's Cholesky factor."""

    bias: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of transformed statistics, in the columns' order."""
        odds = np.full(len(x), self.bias[1] - self.bias[0])
        if self.means is not None:
            for sign, mean, factor in zip((-1, 1), self.means, self.factors, strict=True):
                odds -= sign * 0.5 * _distance(x - mean, factor)
        return np.array([1 / (1 + math.exp(o)) for o in np.clip(-odds / self.temperature, -700, 700).tolist()], float)


def discriminant(moments: dict[int, Moments], pooling: float = 0.6, ridge: float = 0.02, temperature: float = 3.0) -> Model:
    """Shrinkage: ``pooling`` of the pooled covariance, then ``ridge`` of the
    identity times the mean variance. ``temperature`` flattens the odds, since
    the statistics are not quite normal."""
    moments = {k: m for k, m in moments.items() if m.n > 0}
    if len(moments) < 2:
        return Model((0.0, 0.0 if not moments else (700.0 if 1 in moments else -700.0)), None, None, 1.0)
    n = sum(m.n for m in moments.values())
    pooled = sum(m.scatter for m in moments.values()) / n
    floor = max(float(np.trace(pooled)) / SIZE, 1e-6)
    bias, means, factors = [], [], []
    for k in (0, 1):
        m = moments[k]
        cov = (1 - pooling) * m.scatter / m.n + pooling * pooled
        cov = (1 - ridge) * cov + ridge * floor * np.eye(SIZE)
        lower = np.linalg.cholesky((cov + cov.T) / 2)
        bias.append(math.log(m.n / n) - float(np.log(np.diag(lower)).sum()))
        means.append(m.mean)
        factors.append(np.linalg.inv(lower))
    return Model(tuple(bias), tuple(means), tuple(factors), temperature)


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, has_words, x): the transformed statistics of every text."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("has_words", pa.bool_()), ("x", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = np.array([statistics(t) for t in texts(batch)], dtype=float).reshape(-1, SIZE)
            offsets = pa.array(range(0, SIZE * len(raw) + 1, SIZE), pa.int32())
            x = pa.ListArray.from_arrays(offsets, pa.array(transformed(raw).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw[:, 0] > 0), x], schema=schema)

    return rows.mapInArrow(work, "doc_id long, has_words boolean, x array<double>")


def fit(labelled: DataFrame, **shrinkage: float) -> Model:
    """Learn from rows (x, label): a few hundred sums per class, added up by
    Spark, are all that reaches the driver."""
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]

    def total(value: F.Column) -> F.Column:
        return F.sum(F.round(value / UNIT).cast("long")) * F.lit(UNIT)

    sums = [total(F.col("x")[i]).alias(f"s{i}") for i in range(SIZE)]
    products = [total(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    found = labelled.where("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    moments = {}
    for r in found.collect():
        p = np.zeros((SIZE, SIZE))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        moments[int(r["label"])] = Moments(r["n"], np.array([r[f"s{i}"] for i in range(SIZE)]), p)
    return discriminant(moments, **shrinkage)


def score(vectors: DataFrame, model: Model, cutoff: float) -> DataFrame:
    """(doc_id, score, predicted) of rows from ``vectors``; other columns stay."""
    schema = "doc_id long, score double, predicted int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            s = np.where(batch.column("has_words").to_numpy(zero_copy_only=False), model.score(x), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return vectors.select("doc_id", "has_words", "x").mapInArrow(work, schema)


def held_out(column) -> F.Column:
    """Rows kept for testing: crc32 of the id as text is divisible by 5.
    A null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def _learned(x: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where(F.col("label").isNotNull())
    return fit(x.where("has_words").where(~held_out(F.col("doc_id"))).join(known, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least
    ``cutoff``. Rows are judged where they are read: nothing is shuffled but
    the labelled rows' statistics."""
    model = _learned(vectors(docs, id_col, text_col), labels, id_col, label_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = np.array([statistics(t) for t in texts(batch, text_col)], dtype=float).reshape(-1, SIZE)
            keep = (raw[:, 0] > 0) & (model.score(transformed(raw)) >= cutoff)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, learned
    from the labelled rows that are not held out."""
    x = lineage_cut(vectors(docs, id_col, text_col))  # used twice: to learn and to score
    model = _learned(x, labels, id_col, label_col)
    return score(x, model, cutoff).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
