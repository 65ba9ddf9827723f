"""Skew checks on generated data: one key holds a third of all rows.

1. Cart fold (D1) on 1M events against a row-by-row Python replay.
2. Per-key positions (O1/O2) on 1M rows against row_number().

Usage: python tools/skew_checks.py [rows]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402


def cart_events(spark, n):
    h = F.xxhash64("id")
    hot = F.pmod(h, F.lit(3)) == 0
    ops = F.element_at(F.array(*[F.lit(x) for x in ["add"] * 6 + ["change"] * 3 + ["remove"]]),
                       (F.pmod(F.xxhash64(F.col("id") * 7), F.lit(10)) + 1).cast("int"))
    op = F.when(F.pmod(F.xxhash64(F.col("id") * 13), F.lit(5000)) == 0, F.lit("clear")).otherwise(ops)
    secs = F.pmod(F.xxhash64(F.col("id") * 3), F.lit(10_000_000)).cast("decimal(18,6)")
    return spark.range(0, n).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=secs)).alias("ts"),
        F.when(hot, F.lit(1)).otherwise(F.pmod(h, F.lit(5000)) + 2).cast("long").alias("session_id"),
        F.when(hot, F.lit(1)).otherwise(F.pmod(F.xxhash64(F.col("id") * 5), F.lit(4))).cast("long").alias("item_key"),
        op.alias("op"), (F.pmod(F.xxhash64(F.col("id") * 11), F.lit(41)) - 20).cast("int").alias("delta"))


def main() -> None:
    from colorway.operators import carts as CR
    from colorway.operators.ordering import position_within
    from colorway.session import local_session
    from test_carts import replay
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "64"})

    ev = cart_events(spark, n)
    rows = [tuple(r) for r in ev.collect()]
    hot = sum(1 for r in rows if r[2] == 1 and r[3] == 1)
    want = replay(rows)
    t0 = time.perf_counter()
    got = {(r[0], r[1]): r[2] for r in CR.cart_state(ev).collect()}
    print(f"cart fold: {n} events, hot key {hot}, lines {len(want)}, equal {got == want}, "
          f"{time.perf_counter() - t0:.1f}s")

    df = spark.range(0, n).select(
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, F.lit(0))
         .otherwise(F.pmod(F.xxhash64("id"), F.lit(10000)) + 1).alias("k"),
        F.pmod(F.xxhash64(F.col("id") * 7), F.lit(1000)).alias("v"), F.col("id").alias("rid"))
    t0 = time.perf_counter()
    out = position_within(df, ["k"], [(F.col("v"), "desc")], "rid")
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("rid"))
    bad = out.withColumn("want", F.row_number().over(w)).where(F.col("want") != F.col("position")).count()
    print(f"positions: {n} rows, mismatches {bad}, {time.perf_counter() - t0:.1f}s (check included)")


if __name__ == "__main__":
    main()
