"""Account views and keyed state for all users at once (SURVEY J9-J11, P7,
P9, W3-W5, O1, O2, F11, F19, D3, D4).

Per-user "first" rules are min(struct) aggregates (partial aggregation runs
before the shuffle, so a user with a third of all rows is pre-reduced);
per-user positions use ``position_within`` (global sort, no per-key window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.functions import display as D
from colorway.operators import catalog as C
from colorway.operators.ordering import desc_key, first_by, position_within

# Order status bands of the account page.
STATUS_BANDS = [("delivered", "delivered"), ("processing", "processing")]
OTHER_BAND = "other"


def address_book(addresses: DataFrame) -> DataFrame:
    """O1: each user's addresses, default first, newest first (NULLs first,
    the source dialect's DESC); ties by id. Adds ``position``."""
    a = addresses.where(F.col("user_id").isNotNull())
    return position_within(a, ["user_id"], [(F.col("is_default"), "desc_nulls_first"),
                                            (F.col("created_at"), "desc_nulls_first")], "id")


def default_address(addresses: DataFrame) -> DataFrame:
    """Per user, the first default address in display order, else the
    first address in display order."""
    a = addresses.where(F.col("user_id").isNotNull())
    by_time = F.struct(desc_key(F.col("created_at")).alias("t"), F.col("id").alias("i"))
    defaults = first_by(a.where(F.col("is_default")), ["user_id"], by_time, ["id"]).withColumnRenamed("id", "_d")
    # Display order puts NULL is_default first, then true, then false.
    flag = F.when(F.col("is_default").isNull(), 0).when(F.col("is_default"), 1).otherwise(2)
    anyone = first_by(a, ["user_id"], F.struct(flag.alias("f"), by_time.alias("k")), ["id"]).withColumnRenamed("id", "_a")
    out = anyone.join(defaults, "user_id", "left")
    return out.select("user_id", F.coalesce("_d", "_a").alias("address_id"))


def address_default_state(addresses: DataFrame, events: DataFrame) -> DataFrame:
    """After all "set default" events, each user with an event has one
    default: the address of their last event (ts, then event id); users with
    no event keep their flags."""
    last = events.groupBy("user_id").agg(
        F.max_by("address_id", F.struct("ts", "event_id")).alias("_last"))
    out = addresses.join(last, "user_id", "left")
    flag = F.when(F.col("_last").isNull(), F.col("is_default")).otherwise(F.col("id") == F.col("_last"))
    return out.withColumn("is_default", flag).drop("_last")


def address_upsert(addresses: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """D3: update rows whose id exists, insert the others (change side wins
    for every column it carries). When an id may change more than once,
    ``order`` names the columns that order the changes; the last one wins
    (an aggregate, reduced map-side). Without ``order`` ids must be unique."""
    cols = addresses.columns
    if order:
        last = changes.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_c"))
        changes = last.select(*[F.col("_c")[c].alias(c) for c in cols])
    ch = changes.select(*[F.col(c).alias(f"_n_{c}") for c in cols])
    out = addresses.join(ch, addresses["id"] == ch["_n_id"], "full_outer")
    has_change = F.col("_n_id").isNotNull()
    return out.select(*[F.when(has_change, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def address_delete(addresses: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Delete by id."""
    return addresses.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def status_band(status):
    """Delivered / processing / other."""
    expr = F.when(status == STATUS_BANDS[0][0], F.lit(STATUS_BANDS[0][1]))
    for s, band in STATUS_BANDS[1:]:
        expr = expr.when(status == s, F.lit(band))
    return expr.otherwise(F.lit(OTHER_BAND))


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order header with item aggregates (lines, quantity, value) and the
    items as an array ordered by variant id. Items are reduced per order
    before the join; an order with no item keeps [] and zeros."""
    entry = F.struct("variant_id", "quantity", "price")
    agg = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"),
        F.sum(F.col("quantity") * F.col("price")).alias("items_total"),
        F.sort_array(F.collect_list(entry)).alias("order_items"))
    out = orders.join(agg, orders["id"] == agg["order_id"], "left").drop("order_id")
    empty = F.array().cast(agg.schema["order_items"].dataType)
    return (out.withColumn("order_items", F.coalesce("order_items", empty))
               .withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))
               .withColumn("quantity", F.coalesce("quantity", F.lit(0).cast("long")))
               .withColumn("items_total", F.coalesce("items_total", F.lit(0).cast("long"))))


def order_item_details(items: DataFrame, variants: DataFrame, colors: DataFrame, products: DataFrame) -> DataFrame:
    """J10's item display fields: each order line with its product's name and
    slug, the variant's size, its colour's name, and an image (the colour's
    first, else the product's). Lines of unknown variants keep NULLs; their
    variant stands for the colour's id in the join, so they spread over the
    tasks."""
    v = variants.select(F.col("id").alias("variant_id"), "size", "color_id")
    c = colors.select(F.concat(F.lit("="), F.col("id").cast("string")).alias("_key"), "color_name", F.col("images").alias("_ci"))
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("slug").alias("product_slug"), F.col("images").alias("_pi"))
    out = items.join(v, "variant_id", "left").withColumn("_key", F.coalesce(
        F.concat(F.lit("="), F.col("color_id").cast("string")), F.concat(F.lit("-"), F.col("variant_id").cast("string"))))
    out = out.join(c, "_key", "left").join(p, "product_id", "left")
    return out.withColumn("image", D.detail_image(F.col("_ci"), F.col("_pi"))).drop("_ci", "_pi", "_key")


def order_history(orders: DataFrame, items: DataFrame) -> DataFrame:
    """O2: each user's orders, newest first (NULLs first), ties by id, with
    their items and display labels."""
    o = orders.where(F.col("user_id").isNotNull())
    o = position_within(o, ["user_id"], [(F.col("created_at"), "desc_nulls_first")], "id")
    o = orders_with_items(o, items)
    return order_labels(o)


def order_labels(orders: DataFrame) -> DataFrame:
    """label (order number, else first 8 characters of the id),
    upper-cased status, date, and status band."""
    return (orders.withColumn("label", D.order_label(F.col("order_number"), F.col("id")))
                  .withColumn("status_label", F.upper("status"))
                  .withColumn("order_date", F.to_date("created_at"))
                  .withColumn("band", status_band(F.col("status"))))


def wishlist_state(events: DataFrame) -> DataFrame:
    """(user, product) pairs whose last event (ts, event id) is an add."""
    last = events.groupBy("user_id", "product_id").agg(
        F.max_by("op", F.struct("ts", "event_id")).alias("_op"))
    return last.where(F.col("_op") == "add").select("user_id", "product_id")


def wishlist_flag(pairs: DataFrame, wishlist: DataFrame) -> DataFrame:
    """For distinct (user, product) pairs, whether it is wishlisted."""
    w = wishlist.select("user_id", "product_id").withColumn("_hit", F.lit(True))
    out = pairs.select("user_id", "product_id").distinct().join(w, ["user_id", "product_id"], "left")
    return out.withColumn("wishlisted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def id_in_list(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str = "product_id") -> DataFrame:
    """Rows whose key is in a set given as a DataFrame (semi join)."""
    return df.join(ids.select(F.col(ids_key).alias(key)), key, "left_semi")


def wishlist_details(tables, wishlist: DataFrame, user_id=None) -> DataFrame:
    """For each wishlisted (user, product), the active product with its
    category, colours and rating; one user via ``user_id``."""
    w = wishlist if user_id is None else wishlist.where(F.col("user_id") == F.lit(user_id))
    # The reference's two round trips (ids, then products IN ids) as one
    # semi join; for one user the colour and review inputs are cut to that
    # user's products before their aggregates.
    wished = id_in_list(tables["products"], w)
    src = C.for_products(tables, wished) if user_id is not None else {**C._as_dict(tables), "products": wished}
    listed = C.product_list(src)
    return w.join(listed.withColumnRenamed("id", "product_id"), "product_id", "inner")


def user_labels(users: DataFrame, phone: str | None = None) -> DataFrame:
    """welcome name (full name, else e-mail); profile name and phone,
    'Not provided' when missing."""
    ph = F.col(phone) if phone else F.lit(None).cast("string")
    return users.select(F.col("id").alias("user_id"),
                        D.welcome_name(F.col("full_name"), F.col("email")).alias("display_name"),
                        D.or_not_provided(F.col("full_name")).alias("profile_name"),
                        D.or_not_provided(ph).alias("phone"))
