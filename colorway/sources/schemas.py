"""Fixed schemas of the shop tables.

Money is LongType in minor units (1/100). Timestamps are TIMESTAMP_NTZ holding
UTC wall-clock time, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TS = T.TimestampNTZType()
STRS = T.ArrayType(S)


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "categories": _st(("id", S), ("name", S), ("slug", S)),
    "products": _st(
        ("id", L), ("slug", S), ("name", S), ("subtitle", S), ("price", L), ("mrp", L),
        ("badge", S), ("fit_type", S), ("description", S), ("fabric_details", S),
        ("care_instructions", S), ("category_id", S), ("is_active", B), ("images", STRS),
    ),
    "product_colors": _st(
        ("id", S), ("product_id", L), ("color_name", S), ("color_slug", S), ("color_hex", S),
        ("sort_order", I), ("is_active", B), ("images", STRS),
    ),
    "sizes": _st(("label", S), ("sort_order", I)),
    "product_variants": _st(
        ("id", S), ("product_id", L), ("color_id", S), ("sku", S), ("size", S),
        ("inventory_count", L), ("is_active", B),
    ),
    "reviews": _st(
        ("id", S), ("product_id", L), ("user_id", L), ("rating", I), ("created_at", TS),
        ("verified_purchase", B),
    ),
    "users": _st(("id", L), ("full_name", S), ("email", S)),
    "addresses": _st(("id", L), ("user_id", L), ("label", S), ("is_default", B), ("created_at", TS)),
    "address_events": _st(("event_id", L), ("user_id", L), ("address_id", L), ("ts", TS)),
    "orders_t": _st(
        ("id", L), ("user_id", L), ("status", S), ("total_amount", L), ("created_at", TS),
        ("order_number", S), ("shipping_method", S),
    ),
    "order_items": _st(("order_id", L), ("product_id", L), ("variant_id", S), ("quantity", L), ("price", L)),
    "discount_codes": _st(
        ("id", I), ("code", S), ("is_active", B), ("discount_type", S), ("discount_value", I),
        ("starts_at", TS), ("expires_at", TS), ("max_uses", I), ("used_count", I),
        ("min_order_value", I),
    ),
    "shipping_config": _st(("free_above", I), ("flat_rate", I), ("express_rate", I)),
    "checkouts": _st(("session_id", L), ("typed_code", S), ("now_ts", TS), ("shipping_method", S)),
    "order_requests": _st(
        ("request_id", L), ("amount", L), ("customer_id", S), ("address_id", L),
        ("guest_line1", S), ("guest_city", S), ("shipping_method", S), ("shipping_fee", I),
    ),
    "cart_events": _st(
        ("event_id", L), ("ts", TS), ("session_id", L), ("item_key", L), ("op", S), ("delta", I),
    ),
    "wishlist_events": _st(("event_id", L), ("ts", TS), ("user_id", L), ("product_id", L), ("op", S)),
    "payment_events": _st(("event_id", L), ("order_id", L), ("type", S), ("ts", TS)),
    "catalog_changes": _st(
        ("event_id", L), ("ts", TS), ("table_name", S), ("op", S), ("product_id", L),
    ),
    # Stream payloads.
    "payment_feed": _st(("signature", S), ("ts", S), ("body", S)),
    "change_feed": _st(
        ("event_id", L), ("ts", TS), ("table_name", S), ("op", S), ("product_id", L),
        ("old_product_id", L), ("row_id", S),
    ),
}



def _retyped(name: str, **types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType), True) for f in SCHEMAS[name].fields])


def _with(base: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*base.fields, *_st(*fields).fields])


# Tables as the shop stores them: all ids are text (uuids), and they have the
# columns that the derived views lack, among them the stock that the detail page
# shows (``available_count``), percentages with a fraction, and what an order
# line showed when it was sold. Those without a view are here too.
STORED: dict[str, T.StructType] = {
    **{n: SCHEMAS[n] for n in ("categories", "sizes", "shipping_config")},
    "products": _retyped("products", id=S),
    "product_variants": _with(_retyped("product_variants", product_id=S), ("available_count", L)),
    "users": _retyped("users", id=S),
    "order_items": _with(_retyped("order_items", order_id=S, product_id=S), ("product_name", S), ("product_image", S),
                         ("size", S), ("color", S)),
    "discount_codes": _retyped("discount_codes", id=S, discount_value=T.DecimalType(18, 4)),
    "product_colors": _with(_retyped("product_colors", product_id=S), ("created_at", TS), ("updated_at", TS)),
    "reviews": _with(_retyped("reviews", product_id=S, user_id=S), ("comment", S)),
    "addresses": _st(
        ("id", S), ("user_id", S), ("label", S), ("is_default", B), ("created_at", TS), ("address_line_1", S),
        ("address_line_2", S), ("city", S), ("state", S), ("postal_code", S), ("country", S)),
    "orders": _st(
        ("id", S), ("user_id", S), ("status", S), ("total_amount", L), ("created_at", TS), ("order_number", S),
        ("shipping_method", S), ("shipping_fee", L), ("discount_id", S), ("discount_amount", L), ("address_id", S)),
    "wishlists": _st(("user_id", S), ("product_id", S)),
    "cart_sessions": _st(("id", S), ("user_id", S)),
    "cart_items": _st(("session_id", S), ("variant_id", S), ("quantity", L), ("price_at_add", L)),
    "newsletter_subscribers": _st(("email", S)),
    "product_review_aggregates": _st(("product_id", S), ("review_count", L), ("average_rating", T.DecimalType(20, 1))),
}

# The column by which a large table is bucketed and sorted, so that the joins
# and aggregates on it need no shuffle of that table.
BUCKETED_BY = {"products": "id", "product_colors": "id", "product_variants": "color_id", "reviews": "product_id", "users": "id",
               "orders": "id", "order_items": "order_id", "addresses": "user_id", "wishlists": "user_id", "cart_items": "session_id"}

# Order request as posted by the checkout page (nested JSON).
ORDER_REQUEST_JSON = _st(
    ("request_id", S),
    ("action", S),
    ("amount", L),
    ("customerId", S),
    ("customerPhone", S),
    ("customerEmail", S),
    ("orderMeta", _st(
        ("address_id", S),
        ("guest_address", _st(("line1", S), ("city", S), ("state", S), ("postalCode", S))),
        ("discount_id", S),
        ("shipping_method", S),
        ("shipping_fee", L),
        ("discount_amount", L),
    )),
    ("cartItems", T.ArrayType(_st(("variant_id", S), ("qty", L), ("price", L)))),
)


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with its numbers read as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return S


# The request as read from a feed: numbers as text, so that an ill-typed one is
# seen and not lost, and the body itself where it does not have this shape.
MISFIT = "misfit"
ORDER_REQUEST_TEXT = T.StructType([*_as_text(ORDER_REQUEST_JSON).fields, T.StructField(MISFIT, S, True)])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the fixed schema, in its column order."""
    schema = SCHEMAS[name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
