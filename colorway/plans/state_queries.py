"""Registered queries: carts, data checks, sinks and the stream bodies run as
batches over the whole tables (SURVEY D1 D2 D7-D12 S1 S3 S4 S6 X1 X2 X4 X5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.operators import accounts as AC
from colorway.operators import carts as CR
from colorway.operators import catalog as CT
from colorway.operators import orders as OR
from colorway.operators import pricing as PR
from colorway.operators import quality as QL
from colorway.plans.constants import LOAD_TIME, NULL_CHECK_TABLES
from colorway.plans.order_queries import _built
from colorway.plans.queries import flat_catalog, fresh_folder, q_color_catalog, query, text_id
from colorway.sources import feeds as FD
from colorway.sources import io as IO
from colorway.sources import state as ST
from colorway.streaming import jobs as JB
from colorway.streaming import rules as SR


# --- carts -----------------------------------------------------------------------


@query("cart_state")
def q_cart_state(t):
    """Cart lines after replaying all cart events."""
    return CR.cart_state(t["cart_events"])


@query("cart_sessions")
def q_cart_sessions(t):
    """Users with a cart session already (from the cart events) keep it;
    the others get a new one."""
    existing = t["cart_events"].select(F.col("session_id").cast("string").alias("id"),
                                       F.col("session_id").alias("user_id")).distinct()
    return CR.cart_sessions(t["users"], existing)


# --- data checks -----------------------------------------------------------------

@query("variants_migrate")
def q_variants_migrate(t):
    """D7 on the variants in their pre-migration shape (colour columns, no
    colour id)."""
    legacy = (t["product_variants"].drop("color_id")
              .withColumn("color", F.lit("Ash")).withColumn("color_hex", F.lit("#b2beb5"))
              .withColumn("images", F.array().cast("array<string>")))
    return QL.variants_migrate(legacy).select("id", "sku", "color_id")


def _flawed(t) -> dict[str, DataFrame]:
    """The tables with flaws to find: colours entered twice and colours of
    products that are gone, variants of colours that are gone, an order line
    entered twice, and missing values in required and other columns."""
    colors, variants, items, products = (t[n] for n in ("product_colors", "product_variants", "order_items", "products"))
    again = colors.where(F.col("product_id") % 10 == 3)
    lost = colors.where(F.col("product_id") % 20 == 5).withColumn("id", F.concat("id", F.lit("-lost"))) \
        .withColumn("product_id", F.col("product_id") + 100_000_000)
    holes = {"name": 9, "slug": 14, "subtitle": 3}
    return {
        **{n: t[n] for n in ("categories", "reviews", "sizes", "addresses", "orders_t")},
        "product_colors": colors.unionByName(again).unionByName(lost),
        "product_variants": variants.withColumn("color_id", F.when(
            F.col("product_id") % 25 == 4, F.concat("color_id", F.lit("-gone"))).otherwise(F.col("color_id"))),
        "order_items": items.unionByName(items.where(F.col("order_id") % 50 == 7)),
        "products": products.withColumns({c: F.when(F.col("id") % 15 != k, F.col(c)) for c, k in holes.items()}),
    }


@query("key_checks")
def q_key_checks(t):
    """D8 over tables with rows entered twice."""
    return QL.key_checks(_flawed(t))


@query("reference_checks")
def q_reference_checks(t):
    """D9 over tables with colours and variants whose parent is gone."""
    return QL.reference_checks(_flawed(t))


@query("cascade_delete")
def q_cascade_delete(t):
    """The inactive products are deleted; the keys left per table."""
    gone = t["products"].where(~F.col("is_active")).select("id")
    out = QL.cascade_delete(t, gone)
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("key")) for name, df in out.items()])


@query("null_checks")
def q_null_checks(t):
    """D11 over five tables, one with missing values, one without columns
    that it must have."""
    flawed = _flawed(t)
    return reduce(DataFrame.unionByName, [QL.null_checks(flawed[n], n) for n in NULL_CHECK_TABLES])


@query("color_defaults")
def q_color_defaults(t):
    """D12 on the colours (timestamps absent until the load fills them)."""
    out = QL.color_defaults(t["product_colors"], LOAD_TIME)
    return out.select(F.col("id").alias("color_id"), "sort_order", "is_active",
                      F.size("images").cast("long").alias("n_images"),
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# --- streams, as batch transforms over the whole change table -------------------


@query("affected_keys")
def q_affected_keys(t):
    """Product ids made stale by the change feed (products and variants)."""
    return SR.affected_keys(t["catalog_changes"])


# --- sinks and stream bodies over the whole tables ----------------------------------


def _median(df, col: str):
    """The approximate median of a column: one value, read on the driver."""
    return df.agg(F.percentile_approx(col, 0.5).alias("m")).first()["m"]


@query("catalog_sink")
def q_catalog_sink(t):
    """S3: the catalog written as a snapshot version (partitioned by category)
    and read back from the latest committed version."""
    flat = q_color_catalog(t)
    base = fresh_folder(t, "catalog")
    IO.write_snapshot(flat, base, 0, partition_by=["category_slug"])
    return IO.read_snapshot(t.spark, base, schema=flat.schema).select(*flat.columns)


@query("change_feed")
def q_change_feed(t):
    """The change table written as JSON change events and read back
    through the feed reader (batch mode of the same source)."""
    path = fresh_folder(t, "changes")
    IO.write_json_feed(t["catalog_changes"], path)
    return IO.change_feed(t.spark, path, streaming=False).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "table_name", "op", "product_id")


@query("append_rows")
def q_append_rows(t):
    """The order rows of D5 appended in two parts, one of them twice."""
    orders = _built(t)["orders"]
    path = fresh_folder(t, "append")
    for batch in ("guests", "members", "guests"):  # the last is a rerun
        IO.append_rows(orders.where(F.col("user_id").isNull() == F.lit(batch == "guests")), path, batch)
    return IO.read_appended(t.spark, path, orders.schema)


def _older(t) -> dict:
    """The shop before the change feed's changes: the products it names had
    another price, their "a" colours were missing, their variants sold out."""
    ids = SR.affected_keys(t["catalog_changes"], SR.CATALOG_TABLES).select("product_id").withColumn("_old", F.lit(True))
    old = F.coalesce("_old", F.lit(False))
    products = t["products"].join(ids.withColumnRenamed("product_id", "id"), "id", "left")
    colors = t["product_colors"].join(ids, "product_id", "left").where(~(old & (F.col("color_slug") == "a")))
    variants = t["product_variants"].join(ids, "product_id", "left")
    return {**{n: t[n] for n in ("categories", "reviews", "sizes")},
            "products": products.withColumn("price", F.when(old, F.col("price") + 1).otherwise(F.col("price"))).drop("_old"),
            "product_colors": colors.drop("_old"),
            "product_variants": variants.withColumn("inventory_count", F.when(~old, F.col("inventory_count"))
                                                    .otherwise(F.lit(0))).drop("_old")}


#: Bytes of source tables for each bucket of the refreshed catalog. Small
#: buckets, since a batch reads and rewrites whole buckets around its products.
REFRESH_SOURCE_BYTES = 8 * 1024 * 1024


@query("catalog_refresh")
def q_catalog_refresh(t):
    """X2's batch body on the state of the older shop, over the change table in
    two batches, with source tables stored by the product's bucket; the state
    must equal a full rebuild. The number of buckets follows the tables' size,
    so a batch reads and rewrites buckets of one size around its products."""
    base, sources = fresh_folder(t, "refresh"), fresh_folder(t, "sources")
    buckets = min(ST.MOST_BUCKETS, IO.bucket_count(ST.LEAST_BUCKETS, *[t[n] for n in ST.BY_PRODUCT], bytes_each=REFRESH_SOURCE_BYTES))
    ST.create(CT.color_catalog(_older(t)), base, "product_id", buckets)
    ST.store_by_product(t, sources, buckets)
    step = JB.refresh_catalog_batch(lambda: ST.tables_by_product(t.spark, sources), base, source_buckets=buckets)
    feed = t["catalog_changes"]
    cut = _median(feed, "event_id")
    step(feed.where(F.col("event_id") < F.lit(cut)), 0)
    step(feed.where(F.col("event_id") >= F.lit(cut)), 1)
    return flat_catalog(ST.read(t.spark, base))


def _folded(t, events, attrs=None) -> DataFrame:
    """The cart state after two batches (before and from the median time)."""
    base = fresh_folder(t, "carts")
    step = JB.cart_state_batch(base, attrs=attrs)
    cut = _median(events, "ts")
    step(events.where(F.col("ts") < F.lit(cut)), 0)
    step(events.where(F.col("ts") >= F.lit(cut)), 1)
    return ST.read(t.spark, base)


@query("cart_state_stream")
def q_cart_state_stream(t):
    """X5's batch body on the bucketed state, from an empty one; must equal D1."""
    return _folded(t, t["cart_events"])


@query("cart_lines")
def q_cart_lines(t):
    """D1 with the name and price that the add of a line fixes."""
    return CR.cart_state(FD.priced_cart_events(t), attrs=["name", "price"])


@query("cart_lines_stream")
def q_cart_lines_stream(t):
    """X5 with names and prices; must equal ``cart_lines``."""
    return _folded(t, FD.priced_cart_events(t), ["name", "price"])


@query("orders_paid_stream")
def q_orders_paid_stream(t):
    """X4 as a stream over the webhook calls, which come in two parts (event
    ids below and from the median); the second run goes on from the first
    one's checkpoint. The orders joined with the paid ids must equal D6."""
    feed, paid, checkpoint = (fresh_folder(t, n) for n in ("calls", "paid", "paid_checkpoint"))
    calls = FD.payment_feed(t)
    cut = _median(calls, "event_id")
    for k, part in enumerate((calls.where(F.col("event_id") < F.lit(cut)), calls.where(F.col("event_id") >= F.lit(cut)))):
        IO.write_json_feed(part, f"{feed}/part={k}")
        JB.orders_paid_stream(t.spark, f"{feed}/*", FD.TEST_KEY, paid, checkpoint).awaitTermination()
    return JB.orders_with_payments(t["orders_t"], paid).select(F.col("id").alias("order_id"), "status")


def _stored(t, name: str, df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows written as a stored table, in ``least`` buckets or more if they
    come from large tables, and read by ``scan_table``."""
    folder = fresh_folder(t, "stored")
    buckets = IO.bucket_count(least, df) if least else None
    IO.store_table(df, folder, name, buckets)
    return IO.scan_table(t.spark, folder, name, buckets)


@query("scan_orders")
def q_scan_orders(t):
    """D5's orders stored and read under the orders table's schema, then
    marked paid (D6) like any stored order."""
    orders = _stored(t, "orders", _built(t)["orders"].withColumnRenamed("order_id", "id"))
    some = orders.where("conv(substr(id, 1, 1), 16, 10) % 2 = 0").select("id")
    return OR.orders_paid(orders, some).select("id", "user_id", "status", "total_amount", "shipping_fee", "discount_amount", "address_id")


@query("scan_addresses")
def q_scan_addresses(t):
    """D5's guest addresses stored and read with their address lines."""
    return _stored(t, "addresses", _built(t)["addresses"]).select(
        "id", "label", "address_line_1", "address_line_2", "city", "state", "postal_code", "country")


@query("scan_cart_items")
def q_scan_cart_items(t):
    """The priced cart lines stored as cart items."""
    lines = CR.cart_state(FD.priced_cart_events(t), attrs=["name", "price"])
    return _stored(t, "cart_items", lines.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("item_key").cast("string").alias("variant_id"),
        F.col("qty").alias("quantity"), F.col("price").alias("price_at_add")))


@query("scan_review_aggregates")
def q_scan_review_aggregates(t):
    """A3 stored as the review aggregates that the read paths embed."""
    stats = CT.review_stats(t["reviews"]).withColumn("product_id", text_id("prod", "product_id"))
    return _stored(t, "product_review_aggregates", stats).withColumn("average_rating", F.col("average_rating").cast("string"))


@query("scan_wishlists")
def q_scan_wishlists(t):
    """W4's pairs stored as wishlist rows, bucketed by user."""
    pairs = AC.wishlist_state(t["wishlist_events"])
    return _stored(t, "wishlists", pairs.select(text_id("user", "user_id").alias("user_id"), text_id("prod", "product_id").alias("product_id")), 4)


@query("scan_order_items")
def q_scan_order_items(t):
    """Order lines stored with what they showed when they were sold."""
    d = AC.order_item_details(t["order_items"], t["product_variants"], t["product_colors"], t["products"])
    sold = d.withColumns({"order_id": text_id("ord", "order_id"), "product_id": text_id("prod", "product_id"),
                          "product_image": F.col("image"), "color": F.col("color_name")})
    return _stored(t, "order_items", sold, 4)


@query("scan_discount_codes")
def q_scan_discount_codes(t):
    """S1 -> F14, F3: checkouts priced with stored codes, which have text ids
    and percentages with a fraction."""
    codes = t["discount_codes"].withColumn("id", text_id("code", "id")).withColumn("discount_value", F.when(
        F.col("discount_type") == "percentage", F.col("discount_value") + F.lit(0.5)).otherwise(F.col("discount_value")))
    priced = PR.checkout_pricing(t["checkouts"], t["order_items"], _stored(t, "discount_codes", codes), PR.shipping_config(t["shipping_config"]))
    return priced.select("session_id", "discount_status", "discount_id", "discount_amount")
