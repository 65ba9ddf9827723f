"""Registered queries: accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colorway.operators import accounts as AC
from colorway.plans.flat import array_text
from colorway.plans.queries import query


# --- accounts ------------------------------------------------------------------


def _address_changes(t):
    """Changes derived from the set-default events: an update of each named
    address, and a new address per event (negative id)."""
    e = t["address_events"]
    upd = e.select(F.col("address_id").alias("id"), "user_id", F.lit("Updated").alias("label"),
                   F.lit(False).alias("is_default"), F.col("ts").alias("created_at"))
    new = e.select((-F.col("event_id")).alias("id"), "user_id", F.lit("New").alias("label"),
                   F.lit(False).alias("is_default"), F.col("ts").alias("created_at"))
    return upd.unionByName(new)


@query("address_book")
def q_address_book(t):
    """O1."""
    return AC.address_book(t["addresses"]).select("user_id", F.col("id").alias("address_id"), "position")


@query("default_address")
def q_default_address(t):
    """W3."""
    return AC.default_address(t["addresses"])


@query("address_default_state")
def q_address_default_state(t):
    """W5."""
    return AC.address_default_state(t["addresses"], t["address_events"]).select(
        F.col("id").alias("address_id"), "user_id", "is_default")


@query("address_upsert")
def q_address_upsert(t):
    """D3."""
    out = AC.address_upsert(t["addresses"], _address_changes(t))
    return out.select("id", "user_id", "label", "is_default",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("address_delete")
def q_address_delete(t):
    """The addresses named by the events are deleted."""
    ids = t["address_events"].select(F.col("address_id").alias("id"))
    return AC.address_delete(t["addresses"], ids).select("id", "user_id")


@query("status_band")
def q_status_band(t):
    """Orders per band."""
    return (t["orders_t"].groupBy(AC.status_band(F.col("status")).alias("band"))
            .agg(F.count(F.lit(1)).alias("orders")))


@query("orders_with_items")
def q_orders_with_items(t):
    """J10."""
    out = AC.orders_with_items(t["orders_t"], t["order_items"])
    return out.select(F.col("id").alias("order_id"), "lines", "quantity", "items_total",
                      array_text(F.col("order_items"), ["variant_id", "quantity", "price"]).alias("items"))


@query("order_history")
def q_order_history(t):
    """O2."""
    out = AC.order_history(t["orders_t"], t["order_items"])
    return out.select("user_id", F.col("id").alias("order_id"), "position", "label", "status_label",
                      F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "lines", "items_total")


@query("order_labels")
def q_order_labels(t):
    """F11."""
    out = AC.order_labels(t["orders_t"])
    return out.select(F.col("id").alias("order_id"), "label", "status_label",
                      F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@query("wishlist_state")
def q_wishlist_state(t):
    """W4."""
    return AC.wishlist_state(t["wishlist_events"])


@query("wishlist_flag")
def q_wishlist_flag(t):
    """J11 over every (user, product) pair that ever had an event."""
    return AC.wishlist_flag(t["wishlist_events"], AC.wishlist_state(t["wishlist_events"]))


@query("id_in_list")
def q_id_in_list(t):
    """Products on anyone's wishlist."""
    return AC.id_in_list(t["products"], AC.wishlist_state(t["wishlist_events"])).select(
        F.col("id").alias("product_id"))


@query("wishlist_details")
def q_wishlist_details(t):
    """J9 for all users."""
    out = AC.wishlist_details(t, AC.wishlist_state(t["wishlist_events"]))
    return out.select("user_id", "product_id", "category_slug",
                      F.size("product_colors").cast("long").alias("n_colors"), "rating_tenths")


@query("user_labels")
def q_user_labels(t):
    """F19."""
    return AC.user_labels(t["users"])


@query("order_item_details")
def q_order_item_details(t):
    """What an order's lines show (product, size, colour, image)."""
    d = AC.order_item_details(t["order_items"], t["product_variants"], t["product_colors"], t["products"])
    return d.select("order_id", "variant_id", "quantity", "price", "product_name", "product_slug", "size", "color_name", "image")
