"""Registered queries: each key of SURVEY 2 as (spark, sf_dir) -> flat DataFrame.

Every query reads the whole TESTDATA tables through the fixture views. Nested
results are flattened to canonical text (``plans.flat``) so they can be
compared with the DuckDB oracle texts in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.functions import display as D
from colorway.operators import catalog as C
from colorway.operators.ordering import position_within
from colorway.plans.flat import array_text, list_text
from colorway.session import scratch_dir
from colorway.sources import io
from colorway.sources.fixtures import load_tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def fresh_folder(t, name: str) -> str:
    """A new folder under the cluster's checkpoint directory."""
    return scratch_dir(t.spark, f"colorway-{name}-{uuid.uuid4().hex}")


SIZE_FIELDS = ["variant_id", "sku", "size", "inventory_count", "in_stock"]
SIBLING_FIELDS = ["color_id", "color_name", "color_hex", "color_slug", "thumbnail"]


# --- sources / projections / predicates ----------------------------------------

def text_id(prefix: str, value) -> Column:
    """The text id that a stored row has."""
    return F.concat(F.lit(f"{prefix}-"), F.col(value).cast("string"))


@query("scan_table")
def q_scan_table(t):
    """The products table with text ids stored as parquet (under the
    checkpoint directory) and read back with ``scan_table`` under its fixed
    schema."""
    folder = fresh_folder(t, "tables")
    io.store_table(t["products"].withColumn("id", text_id("prod", "id")), folder, "products")
    p = io.scan_table(t.spark, folder, "products")
    return p.select(*[c for c in p.columns if c != "images"], list_text(F.col("images")).alias("images"))


#: Least buckets of the stored catalog tables of the registered key.
STORED_BUCKETS = 8


def stored_catalog(t) -> dict[str, DataFrame]:
    """The catalog's tables as the shop stores them, with text ids and the
    stock that is available (five units less than in the inventory are kept
    back), bucketed by the columns that the catalog joins on."""
    folder = fresh_folder(t, "stored")
    product = text_id("prod", "product_id")
    rows = {
        "products": t["products"].withColumn("id", text_id("prod", "id")),
        "product_colors": t["product_colors"].withColumn("product_id", product),
        "product_variants": t["product_variants"].withColumn("product_id", product)
        .withColumn("available_count", F.greatest(F.col("inventory_count") - 5, F.lit(0).cast("long"))),
        "reviews": t["reviews"].withColumn("product_id", product).withColumn("user_id", text_id("user", "user_id")),
    }
    buckets = io.bucket_count(STORED_BUCKETS, *rows.values())
    for name, df in rows.items():
        io.store_table(df, folder, name, buckets)
    io.store_table(t["categories"], folder, "categories")
    return {**{n: io.scan_table(t.spark, folder, n, buckets) for n in rows}, "categories": io.scan_table(t.spark, folder, "categories")}


@query("catalog_stored")
def q_catalog_stored(t):
    """S1 -> A4: the catalog over the stored, bucketed tables, with the
    available stock."""
    return flat_catalog(C.color_catalog(stored_catalog(t), stock="available_count"))


@query("project_columns")
def q_project_columns(t):
    """Id, name, is_active, category_id."""
    return t["products"].select("id", "name", "is_active", "category_id")


@query("active_products")
def q_active_products(t):
    """P2."""
    return C.active_products(t["products"]).select("id", "slug", "price")


@query("active_pairs")
def q_active_pairs(t):
    """P3."""
    return C.active_pairs(t["product_colors"], t["products"]).select(
        F.col("id").alias("color_id"), "product_id", "color_slug", F.col("p_slug").alias("product_slug"))


@query("category_filter")
def q_category_filter(t):
    """P4 for every category at once."""
    return C.category_filter(t)


@query("size_in_stock")
def q_size_in_stock(t):
    """P8."""
    return t["product_variants"].select(F.col("id").alias("variant_id"),
                                        C.size_in_stock(F.col("inventory_count")).alias("in_stock"))


# --- joins ---------------------------------------------------------------------

@query("color_product")
def q_color_product(t):
    """Inner join colour -> product."""
    p = t["products"].select(F.col("id").alias("product_id"), F.col("slug").alias("product_slug"))
    return t["product_colors"].join(p, "product_id").select(
        F.col("id").alias("color_id"), "product_id", "product_slug", "color_name")


@query("product_category")
def q_product_category(t):
    """Left join product -> category."""
    return C.product_category(t["products"], t["categories"]).select(
        F.col("id").alias("product_id"), "category_name", "category_slug")


@query("product_with_colors")
def q_product_with_colors(t):
    """Product with its colours in (sort_order, id) order."""
    out = C.product_with_colors(t["products"], t["product_colors"])
    return out.select(F.col("id").alias("product_id"),
                      array_text(F.col("product_colors"), ["id", "color_slug", "sort_order"]).alias("colors"),
                      F.size("product_colors").cast("long").alias("n_colors"))


@query("variants_with_size")
def q_variants_with_size(t):
    """J4 inner level: variant with its size row."""
    return C.variants_with_size(t["product_variants"], t["sizes"]).select(
        F.col("id").alias("variant_id"), "size", "size_sort_order")


@query("reviews_with_author")
def q_reviews_with_author(t):
    """J5."""
    return C.reviews_with_author(t["reviews"], t["users"]).select(
        F.col("id").alias("review_id"), "product_id", "rating", "author", "verified_purchase")


@query("color_has_stock")
def q_color_has_stock(t):
    """J6."""
    return C.color_has_stock(t["product_colors"], t["product_variants"]).select(
        F.col("id").alias("color_id"), "has_stock")


@query("sibling_colors")
def q_sibling_colors(t):
    """Each colour row with its product's active colours."""
    sib = C.siblings_by_product(t["product_colors"])
    out = t["product_colors"].join(sib, "product_id", "left")
    return out.select(F.col("id").alias("color_id"),
                      array_text(F.col("all_colors"), SIBLING_FIELDS).alias("all_colors"))


@query("catalog_literal")
def q_catalog_literal(t):
    """The literal view's size list, as entries and a repeat count."""
    out = C.catalog_literal(t)
    return out.select("color_id", "product_id",
                      array_text(F.col("sizes"), SIZE_FIELDS).alias("sizes"), "size_repeats",
                      "n_sizes", "review_count", "rating_tenths")


# --- aggregations ----------------------------------------------------------------

@query("sizes_by_color")
def q_sizes_by_color(t):
    """A1."""
    out = C.sizes_by_color(t["product_variants"])
    return out.select("color_id", array_text(F.col("sizes"), SIZE_FIELDS).alias("sizes"),
                      F.size("sizes").cast("long").alias("n_sizes"), "has_stock")


@query("siblings_by_product")
def q_siblings_by_product(t):
    """A2."""
    out = C.siblings_by_product(t["product_colors"])
    return out.select("product_id", array_text(F.col("all_colors"), SIBLING_FIELDS).alias("all_colors"))


@query("review_stats")
def q_review_stats(t):
    """A3."""
    return C.review_stats(t["reviews"]).select("product_id", "review_count", "rating_tenths")


@query("color_catalog")
def q_color_catalog(t):
    """A4, the flagship."""
    return flat_catalog(C.color_catalog(t))


def flat_catalog(out: DataFrame) -> DataFrame:
    cols = [c for c in C.CATALOG_COLUMNS if c not in ("images", "sizes", "all_colors", "average_rating")]
    return out.select(*cols, list_text(F.col("images")).alias("images"),
                      array_text(F.col("sizes"), SIZE_FIELDS).alias("sizes"),
                      array_text(F.col("all_colors"), SIBLING_FIELDS).alias("all_colors"))


@query("group_by_key")
def q_group_by_key(t):
    """A5."""
    return C.group_by_key(t)


@query("catalog_counts")
def q_catalog_counts(t):
    """A7."""
    return C.catalog_counts(t["products"])


# --- pick-one rules, orders, rows ---------------------------------------------

@query("default_variant")
def q_default_variant(t):
    """W1."""
    return C.default_variant(t).select("color_id", "variant_id", "size")


@query("selected_color")
def q_selected_color(t):
    """Requests are the order lines, asking for the colour of the
    ordered variant (unknown variants ask for no colour)."""
    sel = C.selected_color(_colour_requests(t), t["product_colors"])
    ci = t["product_colors"].select(F.col("id").alias("selected_color_id"), F.col("images").alias("_ci"))
    pi = t["products"].select(F.col("id").alias("product_id"), F.col("images").alias("_pi"))
    out = sel.join(ci, "selected_color_id", "left").join(pi, "product_id", "left")
    return out.select("order_id", "variant_id", "product_id", "requested_slug", "selected_color_id",
                      D.detail_image(F.col("_ci"), F.col("_pi")).alias("image"))


def _colour_requests(t) -> DataFrame:
    v = t["product_variants"].select(F.col("id").alias("variant_id"), F.col("color_id").alias("_cid"))
    c = t["product_colors"].select(F.col("id").alias("_cid"), F.col("color_slug").alias("requested_slug"))
    items = t["order_items"].select("order_id", "variant_id", "product_id")
    return items.join(v, "variant_id", "left").join(c, "_cid", "left").drop("_cid")


@query("size_rank")
def q_size_rank(t):
    """O3."""
    return t["product_variants"].select(F.col("id").alias("variant_id"), "size",
                                        D.size_rank(F.col("size")).alias("size_rank"))


@query("variant_order")
def q_variant_order(t):
    """Variants of each product by size sort_order (missing as 0), id."""
    v = C.variants_with_size(t["product_variants"], t["sizes"])
    out = position_within(v, ["product_id"], [(F.coalesce("size_sort_order", F.lit(0)), "asc")], "id")
    return out.select(F.col("id").alias("variant_id"), "product_id", "position")


@query("featured")
def q_featured(t):
    """First four active products by id."""
    return C.featured(t).select(F.col("id").alias("product_id"), "slug", "name")


@query("shop_cards")
def q_shop_cards(t):
    """G1 (+ F7, F8, F12)."""
    return C.shop_cards(t)


@query("product_list")
def q_product_list(t):
    """R1."""
    p = C.product_list(t)
    return p.select(F.col("id").alias("product_id"), "slug", "name", "subtitle", "price", "mrp",
                    "badge", "fit_type", "category_name", "category_slug",
                    array_text(F.col("product_colors"), ["id", "color_slug"]).alias("colors"),
                    "review_count", "rating_tenths")


@query("product_detail")
def q_product_detail(t):
    """R2 (its reviews are ``product_reviews``)."""
    p = C.product_detail(t)
    return p.select(F.col("id").alias("product_id"), "slug", "category_slug",
                    array_text(F.col("product_colors"), ["id"]).alias("colors"),
                    array_text(F.col("product_variants"), ["id", "size", "size_sort_order"]).alias("variants"),
                    "review_count", "rating_tenths", F.col("average_rating").cast("string").alias("average_rating"))


@query("product_reviews")
def q_product_reviews(t):
    """R2's reviews with their authors, as rows keyed by product."""
    r = C.product_reviews(t)
    return r.select("product_id", "product_slug", F.col("id").alias("review_id"), "author", "rating", "verified_purchase")


# --- scalar rules on the catalog -----------------------------------------------

@query("display_subtitle")
def q_display_subtitle(t):
    """F7 over every (product, colour) pair, and the plain subtitle of
    products without a colour."""
    p = t["products"].select(F.col("id").alias("product_id"), "subtitle")
    c = t["product_colors"].select("product_id", F.col("id").alias("color_id"), "color_name")
    out = p.join(c, "product_id", "left")
    return out.select("product_id", "color_id",
                      D.display_subtitle(F.col("subtitle"), F.col("color_name")).alias("display_subtitle"))


@query("card_images")
def q_card_images(t):
    """F8: primary and alternate image of each listed product."""
    p = C.product_list(t)
    first = F.get(F.col("product_colors"), 0)["images"]
    return p.select(F.col("id").alias("product_id"),
                    D.card_image(F.col("images"), first, 0).alias("image"),
                    D.card_image(F.col("images"), first, 1).alias("alt_image"))


@query("thumbnails")
def q_thumbnails(t):
    """F9."""
    return t["product_colors"].select(F.col("id").alias("color_id"),
                                      D.thumbnail(F.col("images")).alias("thumbnail"))


@query("rating_display")
def q_rating_display(t):
    """one-place average (text) and whole stars."""
    s = C.review_stats(t["reviews"])
    return s.select("product_id", F.col("average_rating").cast("string").alias("average_rating"),
                    D.whole_stars(F.col("rating_tenths")).alias("stars"))


@query("product_links")
def q_product_links(t):
    """F12 for every colour of every product."""
    p = t["products"].select(F.col("id").alias("product_id"), "slug")
    c = t["product_colors"].select("product_id", F.col("id").alias("color_id"), "color_slug")
    return p.join(c, "product_id", "left").select(
        "product_id", "color_id", D.product_link(F.col("slug"), F.col("color_slug")).alias("link"))


@query("sizes_json")
def q_sizes_json(t):
    """the sizes array as JSON text."""
    out = C.sizes_by_color(t["product_variants"])
    return out.select("color_id", F.to_json("sizes").alias("sizes_json"))


def queries() -> dict[str, Query]:
    # Import the other plan modules so their queries register.
    from colorway.plans import account_queries, checkout_queries, order_queries, state_queries  # noqa: F401
    return dict(REGISTRY)
