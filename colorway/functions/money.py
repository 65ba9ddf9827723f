"""Money rules. Amounts are LongType minor units (1/100)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency sign and the Indian digit grouping (last three
# digits, then pairs), e.g. 1234567 -> 12,34,567.
RUPEE = "₹"
INDIAN_GROUPING = r"(?<=\d)(?=(\d{2})*\d{3}$)"

# Shipping config used when the config table has no row
# (free above 5000.00, flat 100.00, express 200.00).
DEFAULT_SHIPPING = {"free_above": 500000, "flat_rate": 10000, "express_rate": 20000}


def price_label(n: Column) -> Column:
    """F1: minor units -> '₹12,34,567.89' (sign after the currency mark)."""
    a = F.abs(n.cast("long"))
    whole = F.regexp_replace((a.cast("decimal(20,0)") / F.lit(100)).cast("long").cast("string"),
                             INDIAN_GROUPING, ",")
    cents = F.lpad((a % 100).cast("string"), 2, "0")
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(n.isNotNull(), F.concat(F.lit(RUPEE), sign, whole, F.lit("."), cents))


def gateway_amount(n: Column) -> Column:
    """F2: minor units -> plain '123.45'."""
    return (n.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").cast("string")


def line_total(qty: Column, price: Column) -> Column:
    """quantity x unit price."""
    return qty.cast("long") * price.cast("long")


def discount_amount(discount_type: Column, discount_value: Column, subtotal: Column) -> Column:
    """fixed -> value; percentage -> floor(subtotal * (value / 100)) in
    double arithmetic, in that order (the value may have a fraction); any
    other type -> 0; capped at the subtotal. A missing value counts as 0."""
    value = F.coalesce(discount_value.cast("double"), F.lit(0.0))
    pct = F.floor(subtotal.cast("double") * (value / F.lit(100.0))).cast("long")
    raw = (F.when(discount_type == "fixed", value.cast("long"))
            .when(discount_type == "percentage", pct)
            .otherwise(F.lit(0).cast("long")))
    return F.least(raw, subtotal.cast("long"))


def shipping_fee(method: Column, subtotal: Column, free_above: Column, flat_rate: Column,
                 express_rate: Column) -> Column:
    """standard -> 0 at or above free_above, else the flat rate;
    express -> the express rate; anything else -> 0. Missing rates are 0."""
    flat = F.coalesce(flat_rate.cast("long"), F.lit(0).cast("long"))
    express = F.coalesce(express_rate.cast("long"), F.lit(0).cast("long"))
    free = subtotal >= F.coalesce(free_above.cast("long"), F.lit(0).cast("long"))
    return (F.when(method == "standard", F.when(free, F.lit(0).cast("long")).otherwise(flat))
             .when(method == "express", express)
             .otherwise(F.lit(0).cast("long")))


def order_total(subtotal: Column, discount: Column, shipping: Column) -> Column:
    """max(0, subtotal - discount + shipping)."""
    return F.greatest(F.lit(0).cast("long"), subtotal.cast("long") - discount.cast("long") + shipping.cast("long"))


def whole_number(value: Column) -> Column:
    """A whole number of at most 64 bits from a number or its text, as the
    database takes it for an integer column; NULL if it is none ("12x",
    "125.5", "true", beyond 64 bits)."""
    text = F.trim(value.cast("string"))
    digits = text.rlike(r"^[+-]?[0-9]{1,18}$")  # the usual shape fits 64 bits and needs no decimals
    exact = F.when(text.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,2})?$"), text).try_cast("decimal(38,9)")
    return F.when(digits, text.try_cast("bigint")).otherwise(F.when(exact == F.floor(exact), exact).try_cast("bigint"))
