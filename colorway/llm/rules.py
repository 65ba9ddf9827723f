"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

``base`` counts what the rules look at. A text is rejected if any of its
statistics exceeds that statistic's cutoff. The cutoffs form one nested path of
vectors, from the loosest to the strictest: FACTORS times the largest value
among good texts, then their QUANTILES. The path is fixed by PATH_SHARE of the
labelled good texts (by a hash of the id, all strata together); the others
test it, per stratum (language; null counts as the empty name). A stratum
tests its vectors in the path's order and stops at the first one for which an
exact one-sided binomial test does not reject "this vector rejects more than
``risk`` of the good texts" (a fixed sequence, which needs no correction among
vectors, since none of its texts helped to fix it). The level is ``error`` /
strata, Bonferroni's correction. So with probability 1 - ``error`` the vectors
chosen falsely reject at most a share ``risk`` in every stratum at once. The
strictest vector that passed is taken; a stratum with none, such as one with
few labels, has no rule. A text is kept if it passes the base rules and its
stratum's.

For the path a statistic is counted on a grid of 1 / GRID up to MOST, so that a
few thousand counts, not the texts, decide its quantiles; the path itself, at
most some 50 numbers, reaches the driver. The number of strata is not limited:
of those that have enough good texts for a rule that rejects none of them to
pass (``least_texts``), a count for each vector reaches the driver; the others
can have no rule, but count among the strata of the correction. The cutoffs go
back as a table that is joined.

Defined results: a null text is an empty text: it has no words and fails.
Repeated rows get equal rows; a null id stays. Without labels only the base
rules apply. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colorway.llm.common import lineage_cut

WINDOW = 8

#: Statistic of each rule, over the columns of ``base``.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "marks": "n_bangs / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}
#: The path: multiples of the largest value among good texts, then quantiles.
FACTORS = (4.0, 3.0, 2.0, 1.5, 1.2, 1.0)
QUANTILES = (0.999, 0.998, 0.995, 0.99)
PATH_SHARE = 2  # tenths of the labelled good texts; the fewer, the more are left to test
GRID, MOST = 1000, 100


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more. Windows
    are compared by 64-bit hashes, made by doubling: pairs, fours, eights."""
    def doubled(hashes: Column, by: int) -> Column:
        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - by, F.lit(0))),
                           lambda h, i: F.xxhash64(h, F.get(hashes, i + by)))

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(
            F.transform(places, lambda p, i: F.when(i < last, F.least(F.get(places, i + 1) - p, F.lit(WINDOW)))
                        .otherwise(F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def twice(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = _let(placed, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))), lambda x: x["i"])))
        return _let(places, covered)

    eights = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda one:
                  _let(doubled(one, 1), lambda two: _let(doubled(two, 2), lambda four: doubled(four, 4))))
    return _let(eights, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(twice(w)))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of every text, with base_failed and the text's stratum."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("words", words).withColumn("lines", lines)

    def without(chars: str) -> Column:
        return F.length("text") - F.length(F.regexp_replace("text", chars, ""))

    counted = rows.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[!?]+").cast("long").alias("n_bangs"),
        without("[A-Z]+").cast("long").alias("n_capitals"))
    return counted.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most k among n at rate p, exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def least_texts(level: float, p: float) -> int:
    """The fewest texts of which none rejected can pass at this level (or one
    less: floating point decides nothing here)."""
    return max(0, math.floor(math.log(level) / math.log1p(-p)))


def fixes_path(doc_id: Column, salt: str = "") -> Column:
    """Whether a labelled text helps to fix the path; the others test it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), doc_id.cast("string"))), 1, 8), 16, 10).cast("long") % 10 < PATH_SHARE


def path(good: DataFrame) -> list[dict[str, float]]:
    """Vectors of cutoffs by rule, loosest first, from ``base``'s rows of good
    texts; empty without any."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(F.expr(e) * GRID), F.lit(MOST * GRID)).alias("x"))
                                 for r, e in RULES.items()])).alias("v")
    counted = good.select(values).groupBy("v.rule", "v.x").agg(F.count(F.lit(1)).alias("n"))  # at most MOST * GRID values a rule
    order = Window.partitionBy("rule")
    counted = counted.withColumn("through", F.sum("n").over(order.orderBy("x"))).withColumn("all", F.sum("n").over(order))
    at = [F.min(F.when(F.col("through") >= F.ceil(F.col("all") * q), F.col("x"))).alias(f"q{k}") for k, q in enumerate(QUANTILES)]
    found = {r["rule"]: r for r in counted.groupBy("rule").agg(F.max("x").alias("most"), *at).collect()}  # a row for each rule
    if not found:
        return []
    return [{r: found[r]["most"] * f / GRID for r in RULES} for f in FACTORS] + \
        [{r: found[r][f"q{k}"] / GRID for r in RULES} for k in range(len(QUANTILES))]


def strictest(n: int, rejected: list[int], risk: float, level: float) -> int | None:
    """Which vector of the path a stratum takes: the last one before the test
    fails, of ``n`` good texts that the vectors reject ``rejected`` of."""
    taken = None
    for k, r in enumerate(rejected):
        if binomial_tail(r, n, risk) > level:
            break
        taken = k
    return taken


def thresholds(stats: DataFrame, good: DataFrame, risk: float = 0.02, error: float = 0.05, salt: str = "") -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, from ``base``'s rows and the ids of good
    texts. The rows that fail the base rules are left out: those are rejected
    anyway."""
    held = lineage_cut(stats.join(good.select("doc_id").distinct(), "doc_id", "left_semi").where(~F.col("base_failed"))
                       .withColumn("on_path", fixes_path(F.col("doc_id"), salt)))  # used for the path and the tests
    vectors = path(held.where("on_path"))
    hits = [F.sum(F.greatest(*[(F.expr(e) > F.lit(v[r])).cast("int") for r, e in RULES.items()])).alias(f"r{k}") for k, v in enumerate(vectors)]
    by_stratum = lineage_cut(held.where("NOT on_path").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits))  # used twice
    strata = by_stratum.count()
    if not strata or not vectors:
        return {}
    level = error / strata
    out: dict[str, dict[str, float]] = {}
    for row in by_stratum.where(F.col("n") >= least_texts(level, risk)).orderBy("stratum").collect():
        taken = strictest(row["n"], [row[f"r{k}"] for k in range(len(vectors))], risk, level)
        if taken is not None:
            out[row["stratum"]] = vectors[taken]
    return out


def judge(stats: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """Adds ``rejected_by``: the rules of the text's stratum that reject it."""
    # a row for each stratum with a rule: at most one in ``least_texts`` labelled texts
    table = stats.sparkSession.createDataFrame(
        [(s, *(c.get(r) for r in RULES)) for s, c in cutoffs.items()],
        ", ".join(["__stratum string", *(f"__{r} double" for r in RULES)]))
    joined = stats.join(F.broadcast(table), F.col("stratum") == F.col("__stratum"), "left")
    verdicts = [F.when(F.expr(e) > F.col(f"__{r}"), F.lit(r)) for r, e in RULES.items()]
    return joined.select(*stats.columns, F.array_compact(F.array(*verdicts)).alias("rejected_by"))


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", stratum_col: str = "lang", risk: float = 0.02, error: float = 0.05, salt: str = "") -> DataFrame:
    """One row per row of ``docs`` with its counts, base_failed, kept and
    rejected_by."""
    stats = lineage_cut(base(docs, id_col, text_col, stratum_col))  # used twice: for the cutoffs and the verdicts
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id"))
    judged = judge(stats, thresholds(stats, good, risk, error, salt))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
