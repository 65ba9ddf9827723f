"""Per-key positions and first-of-group picks that stay correct under skew.

``row_number() over (partition by key ...)`` puts each key in one task, so a
key holding a third of the rows becomes a third of the job in one task. Here
the order is a global sort instead (range partitioning splits a hot key over
many tasks), and a row's position is its global index minus the global index
of its key's first row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colorway.session import lineage_cut, range_partitions

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row in partition


def position_within(df: DataFrame, keys: list[str], order: list[tuple[Column, str]],
                    row_id: str, name: str = "position") -> DataFrame:
    """Add ``name``: 1-based position of each row inside its ``keys`` group.

    ``order`` is a list of (expression, direction) with direction one of
    ``asc``, ``desc``, ``asc_nulls_last``, ``desc_nulls_first``; ``row_id``
    breaks the remaining ties (ascending). NULL keys
    form one group, as in ``partition by``.

    The rows are sorted globally once, with all their columns, and cut from
    their lineage, so every later read sees one partitioning. Nothing is
    joined back by row id: rows with equal or NULL ids are all kept.
    """
    sort_keys = [e.alias(f"_k{i}") for i, (e, _) in enumerate(order)]
    sort_cols = ([F.col(k).asc() for k in keys]
                 + [getattr(F.col(f"_k{i}"), d)() for i, (_, d) in enumerate(order)]
                 + [F.col(row_id).asc()])
    keyed = df.select("*", *sort_keys)
    ranked = lineage_cut(keyed.repartitionByRange(range_partitions(keyed), *sort_cols).sortWithinPartitions(*sort_cols)
                         .select(*df.columns, F.monotonically_increasing_id().alias("_mid")))
    ranked = (ranked.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                    .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    # One row per partition; Spark chooses the join from its measured size.
    offsets = (ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_pid", "_off"))
    indexed = ranked.join(offsets, "_pid").withColumn("_g", F.col("_off") + F.col("_loc"))
    firsts = indexed.groupBy(*keys).agg(F.min("_g").alias("_g0"))
    firsts = firsts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "_g0")
    cond = reduce(lambda a, b: a & b, [indexed[k].eqNullSafe(firsts[f"_f_{k}"]) for k in keys])
    return indexed.join(firsts, cond).select(*df.columns, (F.col("_g") - F.col("_g0") + 1).alias(name))


def first_by(df: DataFrame, keys: list[str], rank: Column, cols: list[str]) -> DataFrame:
    """Per ``keys`` group, the ``cols`` of the row with the smallest ``rank``
    (a struct whose last field should break ties). An aggregate, so partial
    aggregation reduces every key before the shuffle, hot keys included."""
    packed = F.struct(rank.alias("_rank"), *[F.col(c) for c in cols])
    out = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(c) for c in cols])


def desc_key(ts: Column) -> Column:
    """Sort key that orders a timestamp descending with NULLs first, for use
    inside a min(struct): NULL -> smallest, later times -> smaller."""
    micros = wall_micros(ts)
    return F.coalesce(-micros, F.lit(-(1 << 63)).cast("long"))


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of the wall-clock time of a
    TIMESTAMP_NTZ, with no time zone involved."""
    t = ts.cast("timestamp_ntz")
    day = F.unix_date(F.to_date(t)).cast("long") * F.lit(86_400_000_000)
    tod = (F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000
           + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long"))
    return day + tod
