"""Checkout pricing for every cart at once.

Carts are aggregated map-side before their shuffle; discount codes are reduced
to one row per code before they meet the checkouts, so a code used by a third
of all checkouts is one row on the small side (AQE splits the skewed side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.functions import money as M

# Reason codes of the discount check, in the order the checks
# run (the first failing check wins).
REASONS = ["no_code", "no_match", "not_started", "expired", "used_up", "below_minimum", "ok"]


def cart_totals(lines: DataFrame, cart: str = "order_id", qty: str = "quantity",
                price: str = "price") -> DataFrame:
    """Per cart, item count sum(qty), subtotal sum(qty*price), lines."""
    return lines.groupBy(cart).agg(
        F.sum(F.col(qty).cast("long")).alias("item_count"),
        F.sum(M.line_total(F.col(qty), F.col(price))).alias("subtotal"),
        F.count(F.lit(1)).alias("lines"))


def shipping_config(cfg: DataFrame) -> DataFrame:
    """The first config row, or the defaults when the table has no row: one
    row, made inside the plan. An aggregate of at most one row always gives
    one; a column that is NULL in the config row stays NULL."""
    one = cfg.limit(1).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in M.DEFAULT_SHIPPING])
    return one.select(*[F.when(F.col("_n") == 0, F.lit(v)).otherwise(F.col(c)).cast("int").alias(c)
                        for c, v in M.DEFAULT_SHIPPING.items()])


def with_config(df: DataFrame, config: DataFrame) -> DataFrame:
    """``df`` with the config row's values as a column ``_config``: a scalar
    subquery, which runs once with the query."""
    return df.withColumn("_config", config.select(F.struct(*M.DEFAULT_SHIPPING)).scalar())


def exactly_one(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per key, whether exactly one row matches (``lookup`` = ok / many)
    and that row's ``cols`` when it does. One aggregate, partial before the
    shuffle; keys with no row are the caller's left join ('none')."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*cols)).alias("_row"))
    return agg.select(
        *keys, F.when(F.col("_n") == 1, F.lit("ok")).otherwise(F.lit("many")).alias("lookup"),
        *[F.when(F.col("_n") == 1, F.col("_row")[c]).alias(c) for c in cols])


def code_lookup(codes: DataFrame) -> DataFrame:
    """P5 + P6: active codes reduced to one row per code, with how many rows
    matched (``lookup`` = ok / many) and the row itself when exactly one."""
    cols = [c for c in codes.columns if c != "code"]
    return exactly_one(codes.where(F.col("is_active")), ["code"], cols).withColumnRenamed("code", "lookup_code")


def attach_code(carts: DataFrame, codes: DataFrame, typed: str = "typed_code") -> DataFrame:
    """P5: ``upper(input) = code AND is_active`` (input not trimmed); rows
    with no match get lookup = 'none'."""
    look = code_lookup(codes)
    out = carts.join(look, F.upper(F.col(typed)) == look["lookup_code"], "left")
    return out.withColumn("lookup", F.coalesce("lookup", F.lit("none"))).drop("lookup_code")


def discount_reason(typed, now) -> "F.Column":
    """F14 on a row carrying the attached code columns, up to the usage check
    (NULL when those pass). Checks in order; NULL or 0 in max_uses means no
    limit; equal times pass."""
    blank = typed.isNull() | (F.trim(typed) == "")
    max_uses = F.col("max_uses")
    return (F.when(blank, F.lit("no_code"))
             .when(F.col("lookup") != "ok", F.lit("no_match"))
             .when(F.col("starts_at").isNotNull() & (F.col("starts_at") > now), F.lit("not_started"))
             .when(F.col("expires_at").isNotNull() & (F.col("expires_at") < now), F.lit("expired"))
             .when(F.coalesce(max_uses, F.lit(0)) != 0,
                   F.when(F.coalesce(F.col("used_count"), F.lit(0)) >= max_uses, F.lit("used_up")))
             .otherwise(F.lit(None)))


def validate_discounts(carts: DataFrame, codes: DataFrame, typed: str = "typed_code",
                       now: str = "now_ts", subtotal: str = "subtotal") -> DataFrame:
    """F14 + F3: reason code and discount amount for each cart. ``now`` is a
    column (the moment each cart applied its code)."""
    out = attach_code(carts, codes, typed)
    first = discount_reason(F.col(typed), F.col(now))
    # NULL or 0 in min_order_value means no minimum.
    below = (F.coalesce(F.col("min_order_value"), F.lit(0)) != 0) & (F.col(subtotal) < F.col("min_order_value"))
    reason = F.coalesce(first, F.when(below, F.lit("below_minimum")).otherwise(F.lit("ok")))
    out = out.withColumn("discount_status", reason)
    amount = F.when(F.col("discount_status") == "ok",
                    M.discount_amount(F.col("discount_type"), F.col("discount_value"), F.col(subtotal))
                    ).otherwise(F.lit(0).cast("long"))
    return out.withColumn("discount_amount", amount).withColumn(
        "discount_id", F.when(F.col("discount_status") == "ok", F.col("id")))


def checkout_pricing(checkouts: DataFrame, lines: DataFrame, codes: DataFrame, config: DataFrame) -> DataFrame:
    """totals -> discount -> shipping -> total -> labels, per checkout
    session that has items (an empty cart never reaches the pay step).
    ``config`` is the one row of ``shipping_config``."""
    totals = cart_totals(lines).withColumnRenamed("order_id", "session_id")
    carts = checkouts.join(totals, "session_id", "inner")
    priced = with_config(validate_discounts(carts, codes), config)
    fee = M.shipping_fee(F.col("shipping_method"), F.col("subtotal"), F.col("_config.free_above"),
                         F.col("_config.flat_rate"), F.col("_config.express_rate"))
    priced = priced.withColumn("shipping_fee", fee)
    priced = priced.withColumn("total", M.order_total(F.col("subtotal"), F.col("discount_amount"),
                                                      F.col("shipping_fee")))
    return priced.select(
        "session_id", "item_count", "subtotal", "lines", "discount_status", "discount_id",
        "discount_amount", "shipping_method", "shipping_fee", "total",
        M.price_label(F.col("total")).alias("total_label"),
        M.gateway_amount(F.col("total")).alias("gateway_amount"))
