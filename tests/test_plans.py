"""Plan shape: pruning and pushdown reach the scans; no fan-out; the cart
fold never gathers a key."""

import re

from colorway.sources.fixtures import load_tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan: str, table: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and f"{table}.parquet" in line]


def test_catalog_scans_read_only_needed_columns(spark):
    from colorway.operators import catalog as C
    plan = _plan(C.color_catalog(load_tables(spark, SF)))
    scans = _scans(plan, "lineitem")
    assert scans
    for s in scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)
        # Price, discount, tax and dates of lineitem are never read.
        assert "l_extendedprice" not in schema and "l_discount" not in schema and "l_tax" not in schema
        assert "PushedFilters: [IsNotNull(l_partkey)" in s or "PushedFilters: [IsNotNull" in s


def test_filters_reach_the_scan(spark):
    from __spark_entry__ import queries
    df = queries()["payment_status"](spark, SF)
    scans = _scans(_plan(df), "events")
    assert scans and all("EqualTo(event_type,purchase)" in s for s in scans)


def test_pricing_plan_has_no_cartesian_product(spark):
    from __spark_entry__ import queries
    for name in ["checkout_pricing", "color_catalog", "cart_state", "order_history", "wishlist_details"]:
        plan = _plan(queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_cart_fold_groups_are_bounded(spark):
    """Every collect in the cart fold groups by a (key, id >> shift) pair or
    runs on the folded triples, never on a key's raw events."""
    from colorway.operators import carts as CR
    t = load_tables(spark, SF)
    plan = CR.cart_state(t["cart_events"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shiftright") >= 3


def test_classification_is_not_duplicated(spark):
    """The HMAC appears as often as in the bare classification: no filter
    pushdown or inferred constraint re-inlines it."""
    from __spark_entry__ import queries
    qs = queries()
    count = lambda n: qs[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("sha2(")
    base = count("payment_status")
    for n in ["orders_paid", "payment_to_order", "payment_verified"]:
        assert count(n) <= base, n


def test_cart_fold_with_prior_sorts_the_events_once(spark):
    from colorway.operators import carts as CR
    t = load_tables(spark, SF)
    prior = spark.createDataFrame([(1, 1, 2)], "session_id long, item_key long, qty long")
    plan = _plan(CR.cart_state(t["cart_events"], prior))
    assert plan.count("rangepartitioning") == _plan(CR.cart_state(t["cart_events"])).count("rangepartitioning") == 1


def test_positions_join_no_row_back(spark):
    """Neither of the ordered views joins on the row id."""
    from __spark_entry__ import queries
    for name in ["address_book", "variant_order"]:
        plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        # by partition (for the offsets) and by key (for a group's first row)
        ranked = [j for j in joins if "_pid" in j or "<=>" in j]
        own = {"address_book": 0, "variant_order": 1}[name]  # variants meet their sizes
        assert ranked and len(joins) - len(ranked) <= own, joins


def test_positions_keep_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    from colorway.operators.ordering import position_within
    rows = [(None, 1), (2, 1), (2, 1), (3, 2)]
    out = position_within(spark.createDataFrame(rows, "id long, k long"), ["k"], [(F.col("id"), "desc_nulls_first")], "id")
    assert sorted((r.k, r.position, r.id) for r in out.collect()) == [(1, 1, None), (1, 2, 2), (1, 3, 2), (2, 1, 3)]


def test_range_partitions_add_up_the_scans(spark):
    """Above a join the estimate is the sum of the scans, not their product."""
    from colorway.session import range_partitions
    t = load_tables(spark, SF)
    df = t["order_items"].join(t["product_variants"].withColumnRenamed("id", "variant_id"), "variant_id")
    assert range_partitions(df, minimum=4) == 4


def test_key_checks_read_each_table_once(spark):
    """One scan of each table and at most 4 shuffles."""
    from conftest import tables

    from colorway.operators import quality as QL
    t = tables(spark, products=[{"id": 1, "slug": "s", "is_active": True}, {"id": 2, "slug": "s", "is_active": True}, {"id": 3, "slug": None, "is_active": True},
                                {"id": 4, "slug": None, "is_active": False}, {"id": 5, "slug": "", "is_active": True}],
               product_colors=[{"id": c, "product_id": p, "color_slug": k, "is_active": a} for c, p, k, a in
                               [("a", 1, "x", True), ("a", 1, "x", True), ("b", 2, "x", True), ("c", 3, "y", True), ("d", 4, "y", True),
                                ("e", 9, "x", True), ("f", 2, "z", None), ("f", 2, "z", False), ("g", 5, "y", True)]],
               order_items=[{"order_id": 1, "variant_id": "v"}, {"order_id": 1, "variant_id": "v"}, {"order_id": 2, "variant_id": "v"}])
    df = QL.key_checks(t)
    assert {r["check"]: r["violations"] for r in df.collect()} == {
        "colors_product_slug": 2, "catalog_color_id": 1, "catalog_slugs": 1, "cart_session_variant": 1}
    none = QL.key_checks(tables(spark))
    assert {r["check"]: r["violations"] for r in none.collect()} == dict.fromkeys(QL.KEY_CHECKS, 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rfind("Initial Plan"):] if "Initial Plan" in plan else plan
    assert plan.count("Exchange ") <= 5 and plan.count("Scan ExistingRDD") == 3, plan  # 4 shuffles, and a broadcast where AQE may choose one


def test_no_signing_key_in_plans_or_event_logs(scratch):
    """F16: neither explain nor the event log holds the pads of the key."""
    import os
    import subprocess
    import sys
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from colorway.session import local_session
spark = local_session(2, **{{"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false", "spark.eventLog.dir": "file://{scratch}", "spark.sql.maxMetadataStringLength": "100000"}})
from colorway.operators import orders as OR
df = OR.classify_payments(spark.createDataFrame([("s", "1", "5")], "signature string, ts string, body string"), b"a-very-secret-key")
df.collect()
print(df._jdf.queryExecution().toString())
spark.stop()
"""
    from colorway.functions.payments import hmac_pads
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout
    logs = "".join(open(os.path.join(d, f), errors="replace").read() for d, _, fs in os.walk(scratch) for f in fs)
    assert "sha2" in out and "SparkListenerSQLExecutionStart" in logs
    for text in (out, logs):
        for pad in hmac_pads(b"a-very-secret-key"):
            assert pad[:40] not in text.lower() and str(list(bytes.fromhex(pad)))[1:60] not in text
        assert "a-very-secret-key" not in text


def test_bucketed_tables_are_not_shuffled(spark):
    """The catalog over bucketed tables shuffles neither variants nor
    reviews; its colour rows go from colour to product."""
    from colorway.operators import catalog as C
    from colorway.plans.queries import STORED_BUCKETS, stored_catalog
    from colorway.sources.fixtures import load_tables
    before = [spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        t = stored_catalog(load_tables(spark, SF))
        plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan_of(C.sizes_by_color(t["product_variants"], "available_count"))
        assert "Exchange" not in plan_of(C.review_stats(t["reviews"]))
        df = C.color_catalog(t, stock="available_count")
        plan = plan_of(df)
        # colour rows by product; products and categories (no broadcast here) by category, and back by product
        assert plan.count("Exchange ") <= 4 and plan.count("Bucketed: true") == 3, plan
        assert f"SelectedBucketsCount: {STORED_BUCKETS} out of {STORED_BUCKETS}" in plan
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert spark.catalog.listTables() == []


def test_stored_columns_and_text_ids(spark, scratch):
    """What a stored table lacks is NULL; ids are text; a fraction is kept."""
    from colorway.sources import io
    rows = spark.createDataFrame([("0b9c-uuid", "c1", 7)], "id string, color_id string, available_count long")
    for buckets in (None, 3):
        folder = f"{scratch}/{buckets}"
        io.store_table(rows, folder, "product_variants", buckets)
        got = io.scan_table(spark, folder, "product_variants", buckets).collect()
        assert [(r["id"], r["color_id"], r["available_count"], r["product_id"]) for r in got] == [("0b9c-uuid", "c1", 7, None)]
    io.store_table(spark.createDataFrame([("d-uuid", "12.5")], "id string, discount_value string"), scratch, "discount_codes")
    code = io.scan_table(spark, scratch, "discount_codes").first()
    assert code["id"] == "d-uuid" and float(code["discount_value"]) == 12.5


def test_stored_buckets_follow_the_size_of_their_source(spark, monkeypatch):
    """A bucket, which one task sorts, does not grow with the input."""
    from colorway.plans import queries as Q
    from colorway.plans import state_queries as SQ
    from colorway.sources import io
    from colorway.sources.fixtures import load_tables
    t = load_tables(spark, SF)
    lines = t["order_items"]
    assert io.bucket_count(4, lines) == 4
    stored = []
    monkeypatch.setattr(io, "store_table", lambda df, folder, name, buckets=None: stored.append((name, buckets)))
    monkeypatch.setattr(io, "scan_table", lambda spark, folder, name, buckets=None: stored.append((name, buckets)))
    monkeypatch.setattr(io, "source_bytes", lambda df: 10 * io.SOURCE_BYTES_PER_BUCKET)
    SQ._stored(t, "order_items", lines, 4)
    assert stored == [("order_items", 16)] * 2
    stored.clear()
    Q.stored_catalog(t)
    assert {n: b for n, b in stored if n != "categories"} == dict.fromkeys(("products", "product_colors", "product_variants", "reviews"), 64)


def test_key_checks_deal_their_keys_by_the_size_of_the_tables(spark, monkeypatch):
    """The tasks that count keys grow in number, not in size."""
    from colorway.operators import quality as QL
    from colorway.sources.fixtures import load_tables
    t = load_tables(spark, SF)
    monkeypatch.setattr(QL, "KEY_SOURCE_BYTES", 1024)
    plan = QL.key_checks(t)._jdf.queryExecution().optimizedPlan().toString()
    dealt = int(plan.split("RepartitionByExpression")[1].split("], ")[1].split("\n")[0].split(",")[0])
    assert dealt > int(spark.conf.get("spark.sql.shuffle.partitions")), plan
