"""Registered queries: checkout pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from colorway.functions import display as D
from colorway.functions import money as M
from colorway.operators import carts as CR
from colorway.operators import pricing as PR
from colorway.plans.queries import query
from colorway.sources.feeds import priced_cart_events


# --- pricing -------------------------------------------------------------------

@query("cart_totals")
def q_cart_totals(t):
    """Carts are the order lines grouped by order."""
    return PR.cart_totals(t["order_items"])


@query("shipping_config")
def q_shipping_config(t):
    """The config each checkout with items is priced with (first config
    row, else the defaults), and whether its subtotal ships free."""
    return _configured(t, t["shipping_config"])


@query("shipping_config_default")
def q_shipping_config_default(t):
    """S2 where the config table has no row: every checkout gets the defaults."""
    return _configured(t, t["shipping_config"].where(F.col("free_above") < 0))


def _configured(t, cfg):
    totals = PR.cart_totals(t["order_items"]).withColumnRenamed("order_id", "session_id")
    c = PR.with_config(t["checkouts"].join(totals, "session_id"), PR.shipping_config(cfg))
    return c.select("session_id", *[F.col(f"_config.{k}").alias(k) for k in M.DEFAULT_SHIPPING],
                    (F.col("subtotal") >= F.col("_config.free_above")).alias("free_shipping"))


@query("code_lookup")
def q_code_lookup(t):
    """P5: each checkout's typed code matched to an active code."""
    out = PR.attach_code(t["checkouts"], t["discount_codes"])
    return out.select("session_id", "typed_code", F.col("id").alias("code_id"), "lookup")


@query("lookup_one")
def q_lookup_one(t):
    """The detail page's single-row lookup of an active product by slug,
    for the slug of every ordered product: ok / none / many."""
    one = PR.exactly_one(t["products"].where(F.col("is_active")), ["slug"], ["id"])
    asked = t["order_items"].select(F.concat(F.lit("p-"), F.col("product_id").cast("string")).alias("slug")).distinct()
    out = asked.join(one, "slug", "left")
    return out.select("slug", F.coalesce("lookup", F.lit("none")).alias("lookup"), F.col("id").alias("product_id"))


def _priced(t):
    return PR.checkout_pricing(t["checkouts"], t["order_items"], t["discount_codes"],
                               PR.shipping_config(t["shipping_config"]))


@query("discount_check")
def q_discount_check(t):
    """reason code per checkout with items."""
    return _priced(t).select("session_id", "discount_status")


@query("discount_amount")
def q_discount_amount(t):
    """F3 (applied only when the code is valid)."""
    return _priced(t).select("session_id", "subtotal", "discount_amount")


@query("discount_fractions")
def q_discount_fractions(t):
    """F3 with percentages that have a fraction, on every order's total."""
    percent = F.col("id") % 40 + F.lit(0.5)
    return t["orders_t"].select(F.col("id").alias("order_id"), M.discount_amount(
        F.lit("percentage"), percent, F.col("total_amount")).alias("discount_amount"))


@query("cart_checkout")
def q_cart_checkout(t):
    """D1 -> A6 -> F15: the carts that the events leave, priced with the name
    and price their lines were added at."""
    lines = CR.cart_state(priced_cart_events(t), attrs=["name", "price"]).select(
        F.col("session_id").alias("order_id"), F.col("qty").alias("quantity"), "price")
    return PR.checkout_pricing(t["checkouts"], lines, t["discount_codes"], PR.shipping_config(t["shipping_config"]))


@query("shipping_fee")
def q_shipping_fee(t):
    """F4."""
    return _priced(t).select("session_id", "shipping_method", "shipping_fee")


@query("order_total")
def q_order_total(t):
    """F5."""
    return _priced(t).select("session_id", "total")


@query("checkout_pricing")
def q_checkout_pricing(t):
    """the whole rule."""
    return _priced(t)


@query("price_labels")
def q_price_labels(t):
    """F1 over every order total."""
    return t["orders_t"].select(F.col("id").alias("order_id"), "total_amount",
                                M.price_label(F.col("total_amount")).alias("label"))


@query("gateway_amount")
def q_gateway_amount(t):
    """F2 over every order request amount."""
    return t["order_requests"].select("request_id", M.gateway_amount(F.col("amount")).alias("order_amount"))


@query("line_totals")
def q_line_totals(t):
    """F6."""
    return t["order_items"].select("order_id", "variant_id",
                                   M.line_total(F.col("quantity"), F.col("price")).alias("line_total"),
                                   M.price_label(M.line_total(F.col("quantity"), F.col("price"))).alias("label"))


@query("cart_keys")
def q_cart_keys(t):
    """order lines keyed by variant, else 'slug-size' (variant size from
    the variant table; unknown variants have none)."""
    p = t["products"].select(F.col("id").alias("product_id"), "slug")
    v = t["product_variants"].select(F.col("id").alias("_vid"), "size")
    items = t["order_items"].join(p, "product_id", "left")
    items = items.join(v, items["variant_id"] == v["_vid"], "left")
    return items.select("order_id", "variant_id",
                        D.cart_key(F.col("variant_id"), F.col("slug"), F.col("size")).alias("cart_key"))
