"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.llm import bpe, fingerprint, html_text, mixing, near_copies, negatives, packing, quality, rules, substrings, suffix_ranks, toxicity, trie
from colorway.llm.common import input_table
from colorway.llm.oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.join(input_table(spark, sf_dir, "documents"))


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))


def op4_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(input_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(input_table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op6_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(input_table(spark, sf_dir, "pages"))


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(input_table(spark, sf_dir, "documents"))


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


#: The mix of the registered query and the pipeline: half of all tokens.
MIX = mixing.Target(domains={"crawl": 0.4, "web": 0.35, "books": 0.25}, languages={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
                    share=0.5, epochs=2)


def domain(source: F.Column) -> F.Column:
    """The domain of a source: src0 is a crawl, src1 to src9 are web sites,
    the others books."""
    return F.when(source == "src0", "crawl").when(source.rlike("^src[1-9]$"), "web").otherwise("books")


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(input_table(spark, sf_dir, "documents"), MIX, domain)


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(input_table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)
    return packed.select("pack", "row", "n_tokens", "doc_ids", "rows", "parts", "cu_seqlens",
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(input_table(spark, sf_dir, "conversations"))


def op12_suffix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_ranks.kept(input_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(input_table(spark, sf_dir, "embeddings"), negatives.every(50), changed)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it takes its parameters from this module
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_qda, op2_minhash_join, op3_toxicity_ftrl, op4_iblt_fingerprint, op5_byte_bpe, op6_html_tree_model,
        op7_suffix_automata, op8_risk_rules, op9_budget_mix, op10_packed_ids, op11_prefix_trie, op12_suffix_ranks, op13_hard_negatives, pipeline)}
