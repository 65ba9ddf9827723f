"""Rows and helpers shared by the tests of the training-data operators."""

import random

SF = "/root/testdata/sf0.001"

#: Names that operators use inside; an input's own columns may have them.
CLASHES = ["score", "label", "order", "shard", "range", "ahead", "bucket", "batch", "words", "row", "rows", "part",
           "pack", "class_id", "digest", "bands", "copies", "root", "rep", "stratum", "lines", "place", "bin",
           "domain", "language", "leaf", "ids", "url_", "x", "rest", "whole", "own_id", "text_hash", "spans", "mark", "n", "many",
           "kept_id", "kept_mark", "least"]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows():
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    shared = words(rng, 60)
    rows = [
        (1, None, "en", "src0", None), (2, "", "en", "src0", 0), (3, " \n\t ", None, None, 4), (None, "a text without an id", "de", "src1", 20),
        (5, long, "en", "src0", len(long)), (6, long, "en", "src0", len(long)), (7, "x", "fr", "src2", 1), (8, "x", "fr", "src2", 1),
        (9, shared, "en", "src1", len(shared)), (10, words(rng, 9) + " " + shared + "\n" + words(rng, 7), "en", None, None),
        (11, "ä" * 5000, "de", "src3", 5000), (12, "tie " * 400, "en", "src0", 1600), (12, "tie " * 400, "en", "src0", 1600),
        (13, "Ünï códe 日本 \U0001f600   nbsp\r\nline \x0b end", "es", "src4", 30), (None, None, None, None, None),
    ]
    return rows + [(100 + k, words(rng, rng.randint(3, 200)), rng.choice(["en", "de", None]), f"src{k % 4}", 0) for k in range(40)]


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
