from decimal import Decimal

from conftest import tables

from colorway.operators import catalog as C


def _catalog(spark):
    t = tables(
        spark,
        products=[
            {"id": 1, "slug": "p-1", "name": "One", "subtitle": "", "price": 4999, "is_active": True,
             "category_id": "c1", "images": []},
            {"id": 2, "slug": "p-2", "name": "Two", "subtitle": "Brand", "price": 100, "is_active": True,
             "category_id": None, "images": ["/own.jpg"]},
            {"id": 3, "slug": "p-3", "name": "Off", "is_active": False, "images": []},
        ],
        categories=[{"id": "c1", "name": "Jeans", "slug": "jeans"}],
        product_colors=[
            {"id": "1-a", "product_id": 1, "color_name": "Ash", "color_slug": "a", "color_hex": "#1",
             "sort_order": 2, "is_active": True, "images": ["/1a.jpg", "/1a2.jpg"]},
            {"id": "1-n", "product_id": 1, "color_name": "Navy", "color_slug": "n", "color_hex": "#2",
             "sort_order": 0, "is_active": True, "images": []},
            {"id": "1-r", "product_id": 1, "color_name": "Rust", "color_slug": "r", "color_hex": "#3",
             "sort_order": 1, "is_active": False, "images": ["/1r.jpg"]},
            {"id": "3-a", "product_id": 3, "color_name": "Ash", "color_slug": "a", "color_hex": "#1",
             "sort_order": 0, "is_active": True, "images": []},
        ],
        product_variants=[
            {"id": "v3", "product_id": 1, "color_id": "1-a", "sku": "S3", "size": "XL", "inventory_count": 0, "is_active": True},
            {"id": "v1", "product_id": 1, "color_id": "1-a", "sku": "S1", "size": "ONE", "inventory_count": 5, "is_active": True},
            {"id": "v2", "product_id": 1, "color_id": "1-a", "sku": "S2", "size": "XS", "inventory_count": None, "is_active": False},
        ],
        reviews=[
            {"id": "r1", "product_id": 1, "user_id": 7, "rating": 4},
            {"id": "r2", "product_id": 1, "user_id": 8, "rating": 5},
            {"id": "r2", "product_id": 1, "user_id": 8, "rating": 5},
        ],
        users=[{"id": 7, "full_name": "", "email": "a@x"}, {"id": 8, "full_name": "Bea", "email": "b@x"}],
        sizes=[{"label": "XS", "sort_order": 1}, {"label": "XL", "sort_order": 5}],
    )
    return t, {r["color_id"]: r for r in C.color_catalog(t).collect()}


def test_catalog_rows_and_sizes(spark):
    _, rows = _catalog(spark)
    # Active colours of active products only.
    assert set(rows) == {"1-a", "1-n"}
    a = rows["1-a"]
    # Size order XS..XXL then anything else (99); NULL stock stays NULL.
    assert [s["variant_id"] for s in a["sizes"]] == ["v2", "v3", "v1"]
    assert [s["in_stock"] for s in a["sizes"]] == [None, False, True]
    assert a["has_stock"] is True
    # Colour without variants: [] and no stock.
    assert rows["1-n"]["sizes"] == [] and rows["1-n"]["has_stock"] is False
    # Siblings: active colours by sort_order, thumbnail = first image or NULL.
    assert [(c["color_id"], c["thumbnail"]) for c in a["all_colors"]] == [("1-n", None), ("1-a", "/1a.jpg")]
    assert a["category_slug"] == "jeans"


def test_rating_rounding_and_distinct_count(spark):
    _, rows = _catalog(spark)
    a = rows["1-a"]
    # avg(4, 5, 5) = 4.666.. -> 4.7; distinct ids: 2.
    assert a["average_rating"] == Decimal("4.7") and a["rating_tenths"] == 47
    assert a["review_count"] == 2


def test_rating_half_up(spark):
    from pyspark.sql import functions as F
    from colorway.functions import display as D
    df = spark.createDataFrame([(9, 2), (3, 2), (10, 3), (0, 0)], "s long, n long")
    got = [r[0] for r in df.select(D.rating_tenths(F.col("s"), F.col("n"))).collect()]
    assert got == [45, 15, 33, 0]
    stars = [r[0] for r in spark.createDataFrame([(45,), (44,), (0,)], "t long").select(
        D.whole_stars(F.col("t"))).collect()]
    assert stars == [5, 4, 0]


def test_catalog_literal_repeats_sizes(spark):
    t, _ = _catalog(spark)
    lit = {r["color_id"]: r for r in C.expand_literal_sizes(C.catalog_literal(t)).collect()}
    # Three review rows -> each size entry three times, in size order.
    assert [s["variant_id"] for s in lit["1-a"]["sizes"]] == ["v2"] * 3 + ["v3"] * 3 + ["v1"] * 3


def test_shop_cards_and_subtitles(spark):
    t, _ = _catalog(spark)
    cards = {(r["product_id"], r["color_id"]): r for r in C.shop_cards(t).collect()}
    # Product 2 has no colour: one card, own image, plain subtitle, no ?color.
    c2 = cards[(2, None)]
    assert c2["subtitle"] == "Brand" and c2["image"] == "/own.jpg" and c2["link"] == "/product/p-2"
    # Empty subtitle: colour name alone.
    c1 = cards[(1, "1-a")]
    assert c1["subtitle"] == "Ash" and c1["image"] == "/1a.jpg" and c1["alt_image"] == "/1a2.jpg"
    assert c1["link"] == "/product/p-1?color=a"
    # All colours of the product get a card, inactive ones included.
    assert (1, "1-r") in cards and cards[(1, "1-n")]["image"] is None


def test_default_variant_prefers_stock(spark):
    t, _ = _catalog(spark)
    got = {r["color_id"]: r["variant_id"] for r in C.default_variant(t).collect()}
    # Active variants of 1-a: v3 (XL, 0 stock, order 5), v1 (ONE, 5, missing order -> 0).
    # The other colours have no active variant.
    assert got == {"1-a": "v1", "1-n": None, "1-r": None, "3-a": None}


def test_selected_color(spark):
    t, _ = _catalog(spark)
    req = spark.createDataFrame([(1, "r"), (1, "zz"), (1, None), (9, "a")], "product_id long, requested_slug string")
    got = {(r["product_id"], r["requested_slug"]): r["selected_color_id"] for r in
           C.selected_color(req, t["product_colors"]).collect()}
    assert got == {(1, "r"): "1-r", (1, "zz"): "1-n", (1, None): "1-n", (9, "a"): None}


def test_reviews_with_author(spark):
    t, _ = _catalog(spark)
    got = {r["user_id"]: r["author"] for r in C.reviews_with_author(t["reviews"], t["users"]).collect()}
    assert got == {7: "Verified Buyer", 8: "Bea"}


def test_product_list_category_filter(spark):
    t, _ = _catalog(spark)
    assert {r["id"] for r in C.product_list(t).collect()} == {1, 2}
    assert {r["id"] for r in C.product_list(t, category="JEANS").collect()} == {1}


def test_catalog_plan_has_no_fan_out(spark):
    """The view's variants x reviews join never happens: sizes and review
    stats are aggregated before any join."""
    t, _ = _catalog(spark)
    plan = C.color_catalog(t)._jdf.queryExecution().optimizedPlan().toString()
    # sizes per colour and review stats per product are aggregates below the
    # joins; siblings are a window over the product partitioning.
    assert plan.count("Aggregate") >= 2 and "Window" in plan


def test_single_key_paths_equal_filtered_whole(spark):
    """Slug, category, user and top-k calls (inputs cut by semi joins before
    the aggregates) equal the whole-table result filtered to that key."""
    from pyspark.sql import functions as F
    from colorway.operators import accounts as AC
    from colorway.sources.fixtures import load_tables
    t = load_tables(spark, "/root/testdata/sf0.001")

    def rows(df, cols):
        return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())

    cols = ["id", "slug", "category_slug", "review_count", "rating_tenths", "product_colors", "product_variants"]
    full = C.product_detail(t)
    slug = full.orderBy("id").first()["slug"]
    assert rows(C.product_detail(t, slug=slug), cols) == rows(full.where(F.col("slug") == slug), cols)
    lcols = ["id", "category_slug", "review_count", "rating_tenths", "product_colors"]
    whole = C.product_list(t)
    cat = whole.where(F.col("category_slug").isNotNull()).orderBy("id").first()["category_slug"]
    assert rows(C.product_list(t, category=cat.upper()), lcols) == rows(
        whole.where(F.col("category_slug") == cat), lcols)
    assert rows(C.featured(t), lcols) == rows(whole.orderBy("id").limit(4), lcols)
    w = AC.wishlist_state(t["wishlist_events"])
    user = w.orderBy("user_id").first()["user_id"]
    wcols = ["user_id", "product_id", "review_count", "rating_tenths", "product_colors"]
    assert rows(AC.wishlist_details(t, w, user_id=user), wcols) == rows(
        AC.wishlist_details(t, w).where(F.col("user_id") == user), wcols)
