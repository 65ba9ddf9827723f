"""The corpus pipeline: documents in, token ids out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and works on all that its predecessor kept. All but the last return
the columns of ``docs``:

1. quality      the classifier's rejected documents go
2. near_copies  one document of each group of near copies stays: the one with
                the smallest id, of different texts under that id the one with
                the smallest hash; rows without an id take part, after all
                others. Of rows with equal id and text the smallest stays (by
                the columns in order). Different texts under one id are
                documents of their own; texts without a word all stay
3. substrings   words in windows that a smaller document has too go: the text
                becomes the kept words joined by spaces, n_chars its length;
                texts without such words stay as they are
4. mixture      documents by hierarchical budgets; one that two epochs take
                stands twice
5. token_ids    (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row

Learned parts learn from the ``labels`` table in ``sf_dir`` and the documents
that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.llm import bpe, mixing, near_copies, quality, substrings
from colorway.llm.common import input_table, scratch_table, unused
from colorway.llm.queries import MIX, PATTERN, VOCABULARY, domain

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, input_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, mark, least = unused(docs, "kept_id", "kept_mark", "least")
    keys = near_copies.survivors(docs).select(F.col("doc_id").alias(own), F.col("mark").alias(mark))
    kept = docs.withColumn(least, near_copies.mark(F.col("text"))) \
        .join(keys, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(least) == F.col(mark)), "left_semi")
    return kept.groupBy("doc_id", least).agg(F.min(F.struct(*docs.columns)).alias(mark)).select(f"{mark}.*")


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX, domain)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, VOCABULARY, PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_each_group),
    ("substrings", remove_substrings),
    ("mixture", mix_sources),
    ("token_ids", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the shared folder and read again."""
    docs = input_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
