"""Column rules for display values. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Garment size order; any other label ranks 99.
SIZE_RANKS = [("XS", 1), ("S", 2), ("M", 3), ("L", 4), ("XL", 5), ("XXL", 6)]
OTHER_SIZE_RANK = 99

# Separator and fallbacks shown by the storefront.
SUBTITLE_SEPARATOR = " · "
ANONYMOUS_REVIEWER = "Verified Buyer"
NOT_PROVIDED = "Not provided"


def blank_to_null(c: Column) -> Column:
    """JS truthiness for strings: '' counts as missing."""
    return F.when(c != F.lit(""), c)


def size_rank(size: Column) -> Column:
    """O3: XS..XXL -> 1..6, anything else (NULL included) 99."""
    expr = None
    for label, rank in SIZE_RANKS:
        expr = (F.when(size == label, F.lit(rank)) if expr is None
                else expr.when(size == label, F.lit(rank)))
    return expr.otherwise(F.lit(OTHER_SIZE_RANK))


def display_subtitle(subtitle: Column, color_name: Column) -> Column:
    """'subtitle · colour'; colour alone when subtitle is empty; plain
    subtitle when there is no colour."""
    return F.when(color_name.isNull(), subtitle).otherwise(
        F.concat_ws(SUBTITLE_SEPARATOR, blank_to_null(subtitle), color_name))


def thumbnail(images: Column) -> Column:
    """first image (1-based images[1]); NULL for an empty or NULL array."""
    return F.get(images, 0)


def card_image(own_images: Column, color_images: Column, i: int) -> Column:
    """F8: image i of the product, else image i of its first colour; an empty
    text counts as no image."""
    return F.coalesce(blank_to_null(F.get(own_images, i)), blank_to_null(F.get(color_images, i)))


def detail_image(color_images: Column, own_images: Column) -> Column:
    """F8 on the detail page: the selected colour's first image, else the
    product's own."""
    return F.coalesce(blank_to_null(F.get(color_images, 0)), blank_to_null(F.get(own_images, 0)))


def rating_tenths(rating_sum: Column, rating_n: Column) -> Column:
    """average rounded half-up to one place, as integer tenths; 0 if no
    rating. Exact integer arithmetic: (20*s + n) div (2*n)."""
    s, n = rating_sum.cast("long"), rating_n.cast("long")
    return F.when(n > 0, exact_div(s * 20 + n, n * 2)).otherwise(F.lit(0).cast("long"))


def exact_div(num: Column, den: Column) -> Column:
    """floor(num / den) for non-negative longs, exactly: the remainder is
    taken off first, so the decimal division is of an exact multiple."""
    whole = (num - F.pmod(num, den)).cast("decimal(38,0)")
    return (whole / den.cast("decimal(38,0)")).cast("long")


def rating_decimal(tenths: Column) -> Column:
    return (tenths.cast("decimal(20,0)") / F.lit(10)).cast("decimal(20,1)")


def whole_stars(tenths: Column) -> Column:
    """Math.round of the 1-place average (half up)."""
    return F.floor((tenths + F.lit(5)) / F.lit(10)).cast("int")


def product_link(product_slug: Column, color_slug: Column) -> Column:
    """/product/{slug}[?color={colour slug}]."""
    base = F.concat(F.lit("/product/"), product_slug)
    return F.when(blank_to_null(color_slug).isNotNull(),
                  F.concat(base, F.lit("?color="), color_slug)).otherwise(base)


def cart_key(variant_id: Column, slug: Column, size: Column) -> Column:
    """variant id, else 'slug-size'."""
    return F.coalesce(blank_to_null(variant_id), F.concat_ws("-", slug, size))


def reviewer_name(full_name: Column) -> Column:
    """Author name, 'Verified Buyer' when empty."""
    return F.coalesce(blank_to_null(full_name), F.lit(ANONYMOUS_REVIEWER))


def order_label(order_number: Column, order_id: Column) -> Column:
    """order number, else the first 8 characters of the id."""
    return F.coalesce(blank_to_null(order_number), F.substring(order_id.cast("string"), 1, 8))


def welcome_name(full_name: Column, email: Column) -> Column:
    """display name, full name else e-mail."""
    return F.coalesce(blank_to_null(full_name), email)


def or_not_provided(c: Column) -> Column:
    """profile fields default to 'Not provided'."""
    return F.coalesce(blank_to_null(c), F.lit(NOT_PROVIDED))
