import datetime as dt

from pyspark.sql import functions as F

from conftest import frame, tables

from colorway.operators import accounts as AC
from colorway.operators import quality as QL

D = dt.datetime


def test_address_book_and_default(spark):
    rows = [
        {"id": 1, "user_id": 1, "is_default": False, "created_at": D(2024, 1, 3)},
        {"id": 2, "user_id": 1, "is_default": True, "created_at": D(2024, 1, 1)},
        {"id": 3, "user_id": 1, "is_default": False, "created_at": D(2024, 1, 3)},
        {"id": 4, "user_id": 1, "is_default": False, "created_at": None},
        {"id": 5, "user_id": 2, "is_default": False, "created_at": D(2024, 1, 1)},
        {"id": 6, "user_id": 2, "is_default": False, "created_at": D(2024, 1, 2)},
        {"id": 7, "user_id": None, "is_default": True, "created_at": D(2024, 1, 1)},
    ]
    a = frame(spark, "addresses", rows)
    book = sorted((r["user_id"], r["position"], r["id"]) for r in AC.address_book(a).collect())
    # default first, then newest first with NULL first, ties by id
    assert book == [(1, 1, 2), (1, 2, 4), (1, 3, 1), (1, 4, 3), (2, 1, 6), (2, 2, 5)]
    assert {r["user_id"]: r["address_id"] for r in AC.default_address(a).collect()} == {1: 2, 2: 6}
    ev = frame(spark, "address_events", [{"event_id": 1, "user_id": 2, "address_id": 5, "ts": D(2024, 2, 1)},
                                         {"event_id": 2, "user_id": 2, "address_id": 6, "ts": D(2024, 1, 1)}])
    st = {r["id"]: r["is_default"] for r in AC.address_default_state(a, ev).collect()}
    assert st[5] is True and st[6] is False and st[2] is True


def test_wishlist_fold(spark):
    ev = frame(spark, "wishlist_events", [
        {"event_id": 1, "ts": D(2024, 1, 1), "user_id": 1, "product_id": 1, "op": "add"},
        {"event_id": 2, "ts": D(2024, 1, 2), "user_id": 1, "product_id": 1, "op": "remove"},
        {"event_id": 3, "ts": D(2024, 1, 2), "user_id": 1, "product_id": 2, "op": "remove"},
        {"event_id": 4, "ts": D(2024, 1, 2), "user_id": 1, "product_id": 2, "op": "add"},
    ])
    assert {(r[0], r[1]) for r in AC.wishlist_state(ev).collect()} == {(1, 2)}


def test_position_within_splits_hot_key(spark):
    from colorway.operators.ordering import position_within
    df = spark.range(0, 5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"),
                                     (F.col("id") * 7919 % 5000).alias("v"), F.col("id").alias("rid"))
    got = position_within(df.repartition(13), ["k"], [(F.col("v"), "desc")], "rid").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["position"], -r["v"], r["rid"]))
    for k, rows in by_key.items():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_upsert_delete(spark):
    a = frame(spark, "addresses", [{"id": 1, "user_id": 1, "label": "Home"}, {"id": 2, "user_id": 1, "label": "Work"}])
    ch = frame(spark, "addresses", [{"id": 2, "user_id": 1, "label": "Office"}, {"id": 3, "user_id": 2, "label": "New"}])
    got = {r["id"]: r["label"] for r in AC.address_upsert(a, ch).collect()}
    assert got == {1: "Home", 2: "Office", 3: "New"}
    twice = frame(spark, "addresses", [{"id": 2, "user_id": 1, "label": "A", "created_at": D(2024, 1, 1)},
                                       {"id": 2, "user_id": 1, "label": "B", "created_at": D(2024, 1, 2)}])
    got = {r["id"]: r["label"] for r in AC.address_upsert(a, twice, order=["created_at"]).collect()}
    assert got == {1: "Home", 2: "B"}
    left = AC.address_delete(a, spark.createDataFrame([(2,), (9,)], "id long"))
    assert [r["id"] for r in left.collect()] == [1]


def test_quality(spark):
    t = tables(
        spark,
        products=[{"id": 1, "slug": "p", "is_active": True}, {"id": 2, "slug": "q", "is_active": True}],
        product_colors=[{"id": "c1", "product_id": 1, "color_slug": "a", "is_active": True},
                        {"id": "c2", "product_id": 1, "color_slug": "a", "is_active": True},
                        {"id": "c3", "product_id": 9, "color_slug": "b", "is_active": True}],
        product_variants=[{"id": "v1", "color_id": "c1"}, {"id": "v2", "color_id": "zz"},
                          {"id": "v3", "color_id": None}],
    )
    ref = {r["check"]: r["orphans"] for r in QL.reference_checks(t).collect()}
    assert ref == {"color_product": 1, "variant_color": 1}
    dup = QL.duplicate_keys(t["product_colors"], ["product_id", "color_slug"]).collect()
    assert len(dup) == 1 and dup[0]["rows"] == 2
    out = QL.cascade_delete(t, spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in out["products"].collect()] == [2]
    assert [r["id"] for r in out["product_colors"].collect()] == ["c3"]
    assert sorted(r["id"] for r in out["product_variants"].collect()) == ["v2", "v3"]
    nulls = {(r["column"]): r["nulls"] for r in QL.null_checks(t["product_variants"], "v").collect()}
    assert nulls["color_id"] == 1 and nulls["id"] == 0
    legacy = spark.createDataFrame([("v1", "red", "#f00")], "id string, color string, color_hex string")
    m = QL.variants_migrate(legacy)
    assert m.columns == ["id", "color_id"]
    filled = QL.color_defaults(spark.createDataFrame([("c", None, None)], "id string, images array<string>, sort_order int"),
                               "2024-01-01 00:00:00").collect()[0]
    assert filled["images"] == [] and filled["sort_order"] == 0 and filled["is_active"] is True


def test_order_lines_of_unknown_variants_spread_over_the_tasks(spark):
    """Lines without a colour do not meet in one task of the join with the colours."""
    from conftest import tables

    from colorway.operators import accounts as AC
    t = tables(spark, order_items=[{"order_id": k, "product_id": 1, "variant_id": v} for k, v in enumerate(["v1", "x1", "x2", None])],
               product_variants=[{"id": "v1", "size": "M", "color_id": "c1"}, {"id": "v2", "size": "S", "color_id": None}],
               product_colors=[{"id": "c1", "color_name": "Ash", "images": ["a"]}, {"id": None, "color_name": "none", "images": []}],
               products=[{"id": 1, "name": "P", "slug": "p", "images": ["p"]}])
    d = AC.order_item_details(t["order_items"], t["product_variants"], t["product_colors"], t["products"])
    assert {r["order_id"]: (r["color_name"], r["image"], r["size"], r["product_name"]) for r in d.collect()} == {
        0: ("Ash", "a", "M", "P"), 1: (None, "p", None, "P"), 2: (None, "p", None, "P"), 3: (None, "p", None, "P")}
    assert "coalesce(concat(=" in d._jdf.queryExecution().optimizedPlan().toString()
