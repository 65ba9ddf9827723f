"""Mixing sources to target weights by hierarchical budgeting.

The sources form a tree: domain, language, source. A node's budget of tokens
is split among its children by their weights (children without a weight count
1; missing levels of the tree are named by an empty string). A child can use
at most its capacity, its tokens times ``epochs``. What a child cannot use goes
to its siblings that still have room, again by weight, and only what all
siblings together cannot use stays with the parent, whose own siblings then
get it (the children's capacity is the parent's). So a shortage is made good
next to where it arises.

A leaf whose budget is E times its tokens and a rest takes all its documents E
times, and for the rest those that stand first in a seeded order, a new one
for each epoch: the prefix whose tokens sum to no more than the rest. Every
row gets ``copies``, how many epochs take it (0: left out).

Budgets are made by DataFrames: a window over each parent's children, in the
order of their capacity by weight. The tree is the only thing that a window
gathers, never rows: its leaves are counted, not the documents under them, and
no leaf comes to the driver. The prefix needs no window over a leaf: equal
rows are counted first, the order is cut into BINS ranges, whose sums are
added up, and a window then runs within one range of one leaf. The order is
that of a hash of id and text, so rows without an id, or of one id, spread.

Defined results: null and empty texts have no tokens and follow the prefix
they stand in. A null language or source counts as an empty name. Every row
counts, also rows that repeat an id, with the same or another text, and rows
without one; of rows that are equal throughout, ``mix`` has as many as
``select`` gives them copies together. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colorway.llm.common import lineage_cut, row_mark, unused

BINS = 1024
SALT = 64
LEVELS = ("domain", "language", "leaf")


@dataclass(frozen=True)
class Target:
    """Weights by name at each level, the share of all tokens to select, and
    how often a document may be taken."""

    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    share: float = 0.5
    epochs: int = 2
    seed: int = 17


def _weight(name: Column, weights: dict[str, float]) -> Column:
    """A child's weight: a table of the configuration's size, in the plan."""
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, name), F.lit(1.0))


def _split(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits the parent's budget ``b`` among its children of capacity ``c``
    and weight ``w``: in the order of c / w, a child is full if its share of
    what those before it leave reaches its capacity; the others share the rest.
    Children without capacity or weight get nothing."""
    usable = children.where("c > 0 AND w > 0").withColumn("_at", F.col("c") / F.col("w"))
    order = Window.partitionBy(*parent).orderBy("_at", name)
    ahead = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = usable.withColumn("_full", (F.col("b") - ahead) * F.col("w") / onward >= F.col("c"))
    of = Window.partitionBy(*parent)
    held = F.coalesce(F.sum(F.when(F.col("_full"), F.col("c"))).over(of), F.lit(0.0))
    left = F.sum(F.when(~F.col("_full"), F.col("w"))).over(of)
    share = F.when(F.col("_full"), F.col("c")).otherwise((F.col("b") - held) * F.col("w") / left)
    return full.withColumn("b", share).drop("_at", "_full", "c", "w")


def budgets(supply: DataFrame, target: Target) -> DataFrame:
    """(domain, language, leaf, n, budget): tokens for each leaf of ``supply``
    (domain, language, leaf, n)."""
    weights = (target.domains, target.languages, target.sources)
    parents = supply.agg(F.sum("n").alias("n")).select((F.lit(float(target.share)) * F.col("n")).alias("b"), F.lit(0).alias("top"))
    for level in range(3):
        keys = list(LEVELS[:level + 1])
        above = ["top", *LEVELS[:level]]
        children = supply.groupBy(*keys).agg((F.sum("n") * float(target.epochs)).alias("c")) \
            .withColumn("w", _weight(F.col(LEVELS[level]), weights[level])).withColumn("top", F.lit(0))
        parents = _split(children.join(parents, above), above, LEVELS[level])
    return supply.join(parents.drop("top"), list(LEVELS), "left") \
        .select(*LEVELS, "n", F.floor(F.coalesce("b", F.lit(0.0)) + 1e-6).cast("long").alias("budget"))


def _selected(docs: DataFrame, target: Target, domain: Callable[[Column], Column], tokens: Column | None, mark: Column | None,
              id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(doc_id, levels, n_tokens, mark, m, whole, taken): m equal rows, of
    which each is taken ``whole`` times and the first ``taken`` once more.
    Rows are equal in id, text, leaf and tokens, and in ``mark`` if given."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    count = tokens if tokens is not None else F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(domain(source), F.lit("")).alias("domain"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("language"), source.alias("leaf"),
                       count.cast("long").alias("n_tokens"), F.md5(text).alias("text"), (mark if mark is not None else F.lit(0)).alias("mark"))
    # used for the supply and for the selection
    rows = lineage_cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")))
    plan = budgets(rows.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("m")).alias("n")), target)
    whole = F.when(F.col("n") > 0, F.least(F.lit(target.epochs).cast("long"), F.expr("budget div nullif(n, 0)"))).otherwise(F.lit(0).cast("long"))
    plan = plan.withColumn("whole", whole).select(*LEVELS, "whole", F.when(
        F.col("whole") < target.epochs, F.col("budget") - F.col("whole") * F.col("n")).otherwise(F.lit(0).cast("long")).alias("rest"))
    # a hot leaf's rows meet its plan in SALT tasks
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALT)).cast("int")).join(plan, [*LEVELS, "salt"]).drop("salt")

    # only leaves that an epoch takes in part need an order
    order = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.col("whole"), F.lit(target.seed))
    part = dealt.where("rest > 0").withColumn("place", F.conv(F.substring(F.md5(order), 1, 15), 16, 10).cast("long")) \
        .withColumn("bin", F.shiftright("place", 60 - 10).cast("int")).withColumn("sum", F.col("n_tokens") * F.col("m"))
    bins = part.groupBy(*LEVELS, "bin").agg(F.sum("sum").alias("in_bin"))
    before = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("ahead", F.coalesce(F.sum("in_bin").over(before), F.lit(0))).drop("in_bin")  # at most BINS rows a leaf
    within = Window.partitionBy(*LEVELS, "bin").orderBy("place", "doc_id", "text", "mark").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("ahead") - F.coalesce(F.sum("sum").over(within), F.lit(0))
    taken = F.when(room < 0, F.lit(0)).when(F.col("n_tokens") == 0, F.col("m")).otherwise(F.least("m", F.expr("room div nullif(n_tokens, 0)")))
    columns = ["doc_id", *LEVELS, "n_tokens", "mark", "m", "whole"]
    return part.join(bins, [*LEVELS, "bin"]).withColumn("room", room).select(*columns, taken.cast("long").alias("taken")) \
        .unionByName(dealt.where("rest <= 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def select(docs: DataFrame, target: Target, domain: Callable[[Column], Column], tokens: Column | None = None,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs``' ids with their leaf, tokens and copies: (doc_id, domain,
    language, leaf, n_tokens, copies), one row per row of ``docs``. ``domain``
    makes a source's domain; ``tokens`` counts a row's (default: words)."""
    found = _selected(docs, target, domain, tokens, None, id_col, text_col, lang_col, source_col)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return each.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + (F.col("nth") <= F.col("taken")).cast("long")).alias("copies"))


def mix(docs: DataFrame, target: Target, domain: Callable[[Column], Column], id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as it is selected. Rows meet
    their copies by a hash of the whole row (``row_mark``); one row stands for
    those that are equal throughout, as often as they are taken together."""
    mark, n, many = unused(docs, "mark", "n", "many")
    found = _selected(docs, target, domain, None, row_mark(docs), id_col, text_col, lang_col, source_col)
    times = found.select(F.col("mark").alias(mark), (F.col("whole") * F.col("m") + F.col("taken")).alias(n), (F.col("m") > 1).alias(many)).where(F.col(n) > 0)
    marked = docs.withColumn(mark, row_mark(docs))
    one = marked.join(times.where(~F.col(many)), mark)
    equal = marked.join(times.where(F.col(many)), mark)
    # at most as many groups as texts occur twice; a group's rows are equal, so its first by partial aggregation is any
    equal = equal.groupBy(mark, n).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(many)) \
        .select(F.col(n), F.col(f"{many}.*"))
    both = one.select(n, *[F.col(f"`{c}`") for c in docs.columns]).unionByName(equal)
    return both.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*[F.col(f"`{c}`") for c in docs.columns])
