"""Registered queries: orders and payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from colorway.functions import money as M
from colorway.functions import payments as PAY
from colorway.operators import orders as OR
from colorway.plans.queries import fresh_folder, query
from colorway.sources import feeds as FD
from colorway.sources import io as IO


# --- orders and payments ---------------------------------------------------------


@query("order_requests")
def q_order_requests(t):
    """The checkout requests posted as JSON and read by the source
    (flattened here)."""
    path = fresh_folder(t, "requests")
    IO.write_json_feed(FD.checkout_requests(t), path)
    r = IO.order_requests(t.spark, path)
    return r.select("request_id", M.whole_number(F.col("amount")).alias("amount"), F.col("customerId").alias("customer_id"),
                    F.coalesce(F.size("cartItems"), F.lit(0)).cast("long").alias("n_items"),
                    F.col("orderMeta.guest_address").isNotNull().alias("has_guest_address"))


def _built(t):
    return OR.build_orders(FD.checkout_requests(t))


@query("order_build")
def q_order_build(t):
    """Order rows."""
    return _built(t)["orders"]


@query("order_build_addresses")
def q_order_build_addresses(t):
    """New guest address rows."""
    return _built(t)["addresses"]


@query("order_item_rows")
def q_order_item_rows(t):
    """G2."""
    return _built(t)["order_items"]


@query("order_defaults")
def q_order_defaults(t):
    """P10 (+ F2): the gateway payload with its defaults."""
    return _built(t)["gateway"]


@query("guest_owner")
def q_guest_owner(t):
    """P11."""
    r = t["order_requests"]
    return r.select("request_id", OR.guest_owner(F.col("customer_id")).alias("user_id"))


@query("checkout_complete")
def q_checkout_complete(t):
    """Reason per request."""
    r = FD.checkout_requests(t)
    ga = F.col("orderMeta.guest_address")
    reason = OR.checkout_complete(
        F.col("customerId").startswith("guest_"),
        [F.col("guestName"), F.col("customerEmail"), F.col("customerPhone")],
        [ga["line1"], ga["city"], ga["state"], ga["postalCode"]],
        F.col("orderMeta.address_id"))
    return r.select("request_id", reason.alias("reason"))


def _classified(t):
    return OR.classify_payments(FD.payment_feed(t), FD.TEST_KEY)


@query("payment_feed")
def q_payment_feed(t):
    """The signed webhook calls, written as JSON and read by the source."""
    path = fresh_folder(t, "payments")
    IO.write_json_feed(FD.payment_feed(t), path)
    return IO.payment_feed(t.spark, path, streaming=False).select("event_id", "delivery", "ts", "body", "signature")


@query("payment_verified")
def q_payment_verified(t):
    """F16."""
    f = FD.payment_feed(t)
    return f.select("event_id", "delivery",
                    PAY.payment_verified(FD.TEST_KEY, F.col("signature"), F.col("ts"), F.col("body")).alias("verified"))


@query("payment_fields")
def q_payment_fields(t):
    """F17."""
    f = FD.payment_feed(t)
    cols = PAY.payment_fields(F.col("body"))
    return f.select("event_id", "delivery", *[c.alias(n) for n, c in cols.items()])


@query("payment_status")
def q_payment_status(t):
    """X3 over the whole feed as a batch."""
    return _classified(t).select("event_id", "delivery", "status", "paid_order_id")


@query("payment_to_order")
def q_payment_to_order(t):
    """Every webhook call, its paid order id and whether that order exists."""
    return OR.payment_to_order(_classified(t), t["orders_t"]).select(
        "event_id", "delivery", "status", "paid_order_id", "order_found")


@query("orders_paid")
def q_orders_paid(t):
    """D6."""
    out = OR.orders_paid(t["orders_t"], OR.paid_order_ids(_classified(t)))
    return out.select(F.col("id").alias("order_id"), "status")


@query("order_errors")
def q_order_errors(t):
    """S7 -> D5: the requests as a feed in which some bodies are cut, ill-typed
    or of another action, and the error row that each of those gets."""
    path = fresh_folder(t, "flawed_requests")
    FD.flawed_requests(t).write.text(path)
    return OR.build_orders(IO.order_requests(t.spark, path))["errors"]


@query("order_build_flawed")
def q_order_build_flawed(t):
    """S7 -> D5 over the same feed: the orders made from its sound requests,
    with their items' number and sums."""
    path = fresh_folder(t, "flawed_requests")
    FD.flawed_requests(t).write.text(path)
    made = OR.build_orders(IO.order_requests(t.spark, path))
    items = made["order_items"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("value"))
    return made["orders"].join(items, "order_id", "left").select(
        "request_id", "total_amount", "shipping_fee", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("quantity", F.lit(0).cast("long")).alias("quantity"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))


@query("checkout_to_paid")
def q_checkout_to_paid(t):
    """D5 -> X3 -> D6: orders made from the requests, webhook calls that carry
    their ids, and the orders' status after them."""
    orders = _built(t)["orders"].select(F.col("order_id").alias("id"), "order_id", "request_id", "status")
    calls = OR.classify_payments(FD.order_calls(orders), FD.TEST_KEY)
    return OR.orders_paid(orders, OR.paid_order_ids(calls)).select("order_id", "request_id", "status")
