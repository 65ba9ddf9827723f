"""Feeds derived from TESTDATA: webhook calls and checkout requests.

The payment feed rows (which events are malformed, unsigned, forged or
redelivered) are one SQL text that runs unchanged in Spark and DuckDB; the
signature is computed per engine. Requests take the checkout JSON shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.functions.payments import hmac_sha256_base64

# Test signing keys of the webhook feed.
TEST_KEY = b"whsec-colorway-test"
FORGED_KEY = b"not-the-secret"

# One row per webhook call: every purchase event, and a second delivery of
# every fifth. Some bodies are not JSON, 'null' or a bare number; some calls
# carry no timestamp, no signature, or a signature made with another key.
PAYMENT_FEED_SQL = (
    "select event_id, delivery, "
    "case when event_id % 47 = 0 then null else cast(1700000000 + event_id as string) end as ts, "
    "case when event_id % 29 = 0 then '{bad' when event_id % 31 = 0 then 'null' when event_id % 37 = 0 then '5' "
    "else concat('{\"type\":\"', case when event_id % 6 = 0 then 'PAYMENT_FAILED_WEBHOOK' else 'PAYMENT_SUCCESS_WEBHOOK' end, "
    "'\",\"data\":{\"order\":{\"order_id\":', case when event_id % 23 = 0 then 'null' when event_id % 19 = 0 "
    "then concat('\"', cast(-event_id as string), '\"') else concat('\"', cast(event_id as string), '\"') end, '}}}') end as body, "
    "case when event_id % 41 = 0 then 'none' when event_id % 43 = 0 then 'forged' else 'good' end as signing "
    "from (select event_id, 1 as delivery from events where event_type = 'purchase' "
    "union all select event_id, 2 as delivery from events where event_type = 'purchase' and event_id % 5 = 0) as d"
)


def payment_feed(tables) -> DataFrame:
    """S5 rows built from the purchase events, signed with ``TEST_KEY``."""
    raw = tables.sql(PAYMENT_FEED_SQL)
    msg = F.concat(F.col("ts"), F.col("body"))
    sig = (F.when(F.col("signing") == "good", hmac_sha256_base64(TEST_KEY, msg))
            .when(F.col("signing") == "forged", hmac_sha256_base64(FORGED_KEY, msg))
            .otherwise(F.lit("")))
    return raw.select(F.col("event_id").cast("long"), F.col("delivery").cast("int"), "ts", "body",
                      sig.alias("signature"))


def order_calls(orders: DataFrame) -> DataFrame:
    """Webhook calls about created orders (order_id, request_id), carrying
    their text ids: every fifth request's payment failed, every seventh call
    is forged, every eleventh unsigned."""
    rid = F.col("request_id").cast("long")
    kind = F.when(rid % 5 == 0, F.lit("PAYMENT_FAILED_WEBHOOK")).otherwise(F.lit("PAYMENT_SUCCESS_WEBHOOK"))
    calls = orders.select(
        "order_id", rid.alias("event_id"), F.concat(F.lit("17"), rid.cast("string")).alias("ts"),
        F.to_json(F.struct(kind.alias("type"), F.struct(F.struct("order_id").alias("order")).alias("data"))).alias("body"))
    msg = F.concat("ts", "body")
    signature = (F.when(F.col("event_id") % 11 == 0, F.lit(""))
                  .when(F.col("event_id") % 7 == 0, hmac_sha256_base64(FORGED_KEY, msg))
                  .otherwise(hmac_sha256_base64(TEST_KEY, msg)))
    return calls.select("event_id", F.lit(1).alias("delivery"), signature.alias("signature"), "ts", "body")


def priced_cart_events(tables) -> DataFrame:
    """The cart events with the name and price an item has at their time: the
    price rises by 1.00 with every tenth event of the log."""
    ev = tables["cart_events"]
    return (ev.withColumn("name", F.concat(F.lit("Item "), F.col("item_key").cast("string")))
              .withColumn("price", (F.col("item_key") + 1) * 10000 + F.expr("(event_id div 10) * 100")))


def checkout_requests(tables) -> DataFrame:
    """S7 rows: each order request in the checkout JSON shape. The cart is
    the order's lines; guests get a contact and address made from the
    request (phone only with a city; state and post code only for Pune);
    members send their e-mail. Requests without a user's id get a key of their
    own that meets no user, so they spread over the tasks."""
    r = tables["order_requests"]
    cart = tables["order_items"].groupBy("order_id").agg(F.sort_array(F.collect_list(
        F.struct("variant_id", F.col("quantity").alias("qty"), "price"))).alias("cartItems"))
    users = tables["users"].select(F.concat(F.lit("="), F.col("id").cast("string")).alias("_uid"), F.col("email").alias("_email"))
    r = r.join(cart, r["request_id"] == cart["order_id"], "left").drop("order_id")
    r = r.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("customer_id").try_cast("bigint").cast("string")),
                                        F.concat(F.lit("-"), F.col("request_id").cast("string"))))
    r = r.join(users, r["_key"] == users["_uid"], "left")
    guest = F.col("customer_id").startswith("guest_")
    rid = F.col("request_id")
    pune = F.col("guest_city") == "Pune"
    phone = F.when(guest & F.col("guest_city").isNotNull(),
                   F.concat(F.lit("98"), F.lpad((rid % 100000000).cast("string"), 8, "0")))
    guest_address = F.when(guest, F.struct(
        F.col("guest_line1").alias("line1"), F.col("guest_city").alias("city"),
        F.when(pune, F.lit("MH")).alias("state"), F.when(pune, F.lit("411001")).alias("postalCode")))
    return r.select(
        rid.cast("string").alias("request_id"), F.lit("create-order").alias("action"), "amount",
        F.col("customer_id").alias("customerId"),
        F.when(guest, phone).alias("customerPhone"),
        F.when(guest, F.concat(F.lit("guest"), rid.cast("string"), F.lit("@example.com")))
         .otherwise(F.col("_email")).alias("customerEmail"),
        F.when(guest, F.concat(F.lit("Guest "), rid.cast("string"))).alias("guestName"),
        F.struct(F.col("address_id").cast("string").alias("address_id"), guest_address.alias("guest_address"),
                 F.lit(None).cast("string").alias("discount_id"), F.col("shipping_method"),
                 F.col("shipping_fee").cast("long").alias("shipping_fee"),
                 F.lit(None).cast("long").alias("discount_amount")).alias("orderMeta"),
        "cartItems")


# The flaws of the request feed. A request gets the first whose
# number divides its id.
FLAWS = {"refund": 101, "no_action": 103, "amount_text": 107, "amount_fraction": 109, "no_amount": 113, "quantity": 127,
         "price": 131, "fee": 137, "cut": 139, "list": 149, "no_id": 151, "amount_as_text": 7}


def flawed_requests(tables) -> DataFrame:
    """S7 lines: the checkout requests as JSON text, some of them flawed: other
    actions, amounts of text or with a fraction, cut bodies (see ``FLAWS``).
    Amounts in quotes that are numbers are no flaw."""
    whole = checkout_requests(tables)
    rid = F.col("request_id").cast("long")
    flaw = F.coalesce(*[F.when(rid % n == 0, F.lit(name)) for name, n in FLAWS.items()], F.lit(""))
    body = F.to_json(F.struct(*[c for c in whole.columns]))
    is_ = lambda name: F.col("flaw") == name
    lines = whole.select("request_id", flaw.alias("flaw"), body.alias("body"))
    return lines.select(
        F.when(is_("refund"), F.regexp_replace("body", '"create-order"', '"refund"'))
         .when(is_("no_action"), F.regexp_replace("body", '"action":"create-order",', ""))
         .when(is_("amount_text"), F.regexp_replace("body", '"amount":[0-9]+', '"amount":"12x"'))
         .when(is_("amount_fraction"), F.regexp_replace("body", '"amount":[0-9]+', '"amount":125.5'))
         .when(is_("no_amount"), F.regexp_replace("body", '"amount":[0-9]+,', ""))
         .when(is_("quantity"), F.regexp_replace("body", '"qty":[0-9]+', '"qty":"two"'))
         .when(is_("price"), F.regexp_replace("body", '"price":[0-9]+', '"price":null'))
         .when(is_("fee"), F.regexp_replace("body", '"shipping_fee":[0-9]+', '"shipping_fee":"free"'))
         .when(is_("cut"), F.substring("body", 1, 24))
         .when(is_("list"), F.concat(F.lit("["), F.col("request_id"), F.lit("]")))
         .when(is_("no_id"), F.lit('{"action":"create-order","amount":5}'))
         .when(is_("amount_as_text"), F.regexp_replace("body", '"amount":([0-9]+)', '"amount":"$1"'))
         .otherwise(F.col("body")).alias("value"))
