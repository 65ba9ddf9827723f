import datetime as dt

from pyspark.sql import functions as F

from conftest import frame

from colorway.functions import money as M
from colorway.operators import pricing as PR

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _codes(spark):
    rows = [
        {"id": 1, "code": "FIXED", "is_active": True, "discount_type": "fixed", "discount_value": 500},
        {"id": 2, "code": "PCT", "is_active": True, "discount_type": "percentage", "discount_value": 29},
        {"id": 3, "code": "ODD", "is_active": True, "discount_type": "bogus", "discount_value": 50},
        {"id": 4, "code": "EDGE", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "starts_at": T0, "expires_at": T0},
        {"id": 5, "code": "LATER", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "starts_at": T0 + dt.timedelta(seconds=1)},
        {"id": 6, "code": "OLD", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "expires_at": T0 - dt.timedelta(seconds=1)},
        {"id": 7, "code": "ZERO", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "max_uses": 0, "used_count": 99, "min_order_value": 0},
        {"id": 8, "code": "USED", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "max_uses": 3, "used_count": 3},
        {"id": 9, "code": "MIN", "is_active": True, "discount_type": "fixed", "discount_value": 1,
         "min_order_value": 101},
        {"id": 10, "code": "DUP", "is_active": True, "discount_type": "fixed", "discount_value": 1},
        {"id": 11, "code": "DUP", "is_active": True, "discount_type": "fixed", "discount_value": 1},
        {"id": 12, "code": "OFF", "is_active": False, "discount_type": "fixed", "discount_value": 1},
        {"id": 13, "code": "BIG", "is_active": True, "discount_type": "fixed", "discount_value": 10**6},
    ]
    return frame(spark, "discount_codes", rows)


def _check(spark, typed, subtotal=100):
    carts = spark.createDataFrame([(1, typed, T0, subtotal)],
                                  "session_id long, typed_code string, now_ts timestamp_ntz, subtotal long")
    r = PR.validate_discounts(carts, _codes(spark)).collect()[0]
    return r["discount_status"], r["discount_amount"]


def test_reasons_in_order(spark):
    assert _check(spark, "fixed") == ("ok", 100)  # 500 capped at the subtotal
    assert _check(spark, "pct") == ("ok", 28)  # floor(100 * (29 / 100)) in doubles
    assert _check(spark, "odd") == ("ok", 0)
    assert _check(spark, "edge") == ("ok", 1)  # equal times pass
    assert _check(spark, "later")[0] == "not_started"
    assert _check(spark, "old")[0] == "expired"
    assert _check(spark, "zero") == ("ok", 1)  # 0 means no limit
    assert _check(spark, "used")[0] == "used_up"
    assert _check(spark, "min")[0] == "below_minimum"
    assert _check(spark, "dup")[0] == "no_match"  # more than one row
    assert _check(spark, "off")[0] == "no_match"  # inactive
    assert _check(spark, " fixed")[0] == "no_match"  # input not trimmed
    assert _check(spark, "  ")[0] == "no_code"
    assert _check(spark, "big", subtotal=700) == ("ok", 700)


def test_shipping_config_empty_and_present(spark):
    empty = spark.createDataFrame([], "free_above int, flat_rate int, express_rate int")
    assert [r.asDict() for r in PR.shipping_config(empty).collect()] == [M.DEFAULT_SHIPPING]
    one = spark.createDataFrame([(1, 2, 3)], "free_above int, flat_rate int, express_rate int")
    assert [r.asDict() for r in PR.shipping_config(one).collect()] == [{"free_above": 1, "flat_rate": 2, "express_rate": 3}]


def test_shipping_total_and_labels(spark):
    df = spark.createDataFrame(
        [("standard", 500000), ("standard", 499999), ("express", 10), ("pickup", 10), (None, 10)],
        "m string, s long")
    fee = M.shipping_fee(F.col("m"), F.col("s"), F.lit(500000), F.lit(10000), F.lit(20000))
    assert [r[0] for r in df.select(fee).collect()] == [0, 10000, 20000, 0, 0]
    tot = spark.createDataFrame([(100, 500, 0)], "s long, d long, f long").select(
        M.order_total(F.col("s"), F.col("d"), F.col("f"))).collect()[0][0]
    assert tot == 0
    n = spark.createDataFrame([(123456789,), (5,), (100000,), (-150,), (99999999999,)], "n long")
    got = [r[0] for r in n.select(M.price_label(F.col("n"))).collect()]
    assert got == ["₹12,34,567.89", "₹0.05", "₹1,000.00", "₹-1.50", "₹99,99,99,999.99"]
    assert [r[0] for r in n.select(M.gateway_amount(F.col("n"))).collect()][:4] == [
        "1234567.89", "0.05", "1000.00", "-1.50"]


def test_fixture_reason_counts(spark):
    """The reason counts measured at sf0.01 (FIXTURES.md)."""
    from __spark_entry__ import queries
    df = queries()["discount_check"](spark, "/root/testdata/sf0.01")
    got = {r[0]: r[1] for r in df.groupBy("discount_status").count().collect()}
    assert got == {"no_match": 3778, "not_started": 1212, "expired": 1477, "used_up": 2409,
                   "below_minimum": 284, "ok": 5583}


def test_config_is_read_with_the_query_not_before(spark):
    """Building the priced plan runs no job; NULL columns of a row stay NULL."""
    jobs = spark.sparkContext.statusTracker()
    group = "no-job-while-planning"
    spark.sparkContext.setJobGroup(group, group)
    cfg = spark.createDataFrame([(None, 2, 3), (9, 9, 9)], "free_above int, flat_rate int, express_rate int").coalesce(1)
    df = PR.with_config(spark.range(2), PR.shipping_config(cfg))
    assert len(jobs.getJobIdsForGroup(group)) == 0
    rows = df.collect()
    assert len(jobs.getJobIdsForGroup(group)) > 0
    spark.sparkContext._jsc.clearJobGroup()
    assert len(rows) == 2 and all(r["_config"]["free_above"] in (None, 9) for r in rows)
