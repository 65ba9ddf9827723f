"""Catalog jobs: the colour-first catalog and the product read paths.

Every "first"/"ordered" rule has a written tie-break (SURVEY Q8): colours by
(sort_order, id), sizes by (size rank, variant id), variants by (size
sort_order or 0, id). Aggregates are computed per branch before the joins, so
the reference view's join fan-out (variants x reviews, Q1) never materialises.

Nested arrays are per colour (sizes, bounded by the size table) and per
product (colours, variants); reviews are never nested - they are a separate
per-review DataFrame, since one product may hold any share of all reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colorway.functions import display as D
from colorway.operators.ordering import first_by


# --- predicates (P2, P3, P8) -------------------------------------------------

def active_products(products: DataFrame) -> DataFrame:
    """is_active = true."""
    return products.where(F.col("is_active"))


def active_pairs(colors: DataFrame, products: DataFrame) -> DataFrame:
    """P3 + J1: active colour of an active product (filters below the join)."""
    p = active_products(products).select(F.col("id").alias("product_id"), *[
        F.col(c).alias(f"p_{c}") for c in products.columns if c != "id"])
    return colors.where(F.col("is_active")).join(p, "product_id", "inner")


def size_in_stock(stock):
    """Stock > 0 as a field; NULL stays NULL."""
    return stock > F.lit(0)


# --- aggregations (A1, A2, A3, J6) --------------------------------------------

def sizes_by_color(variants: DataFrame, stock: str = "inventory_count") -> DataFrame:
    """A1 + J6: per colour, sizes in size order and whether any has stock.

    Returns (color_id, sizes array<struct<variant_id, sku, size,
    inventory_count, in_stock>>, has_stock). Variant rows without id are
    skipped (the FILTER of the view); the stock flag reads all variants of the
    colour, active or not, as the view does.
    """
    v = variants.where(F.col("color_id").isNotNull())
    entry = F.struct(
        D.size_rank(F.col("size")).alias("rank"),
        F.col("id").alias("variant_id"), "sku", "size",
        F.col(stock).alias("inventory_count"),
        size_in_stock(F.col(stock)).alias("in_stock"))
    agg = v.groupBy("color_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), entry))).alias("_s"),
        F.coalesce(F.max(size_in_stock(F.col(stock))), F.lit(False)).alias("has_stock"))
    sizes = F.transform("_s", lambda s: F.struct(
        s["variant_id"].alias("variant_id"), s["sku"].alias("sku"), s["size"].alias("size"),
        s["inventory_count"].alias("inventory_count"), s["in_stock"].alias("in_stock")))
    return agg.select("color_id", sizes.alias("sizes"), "has_stock")


def color_has_stock(colors: DataFrame, variants: DataFrame, stock: str = "inventory_count") -> DataFrame:
    """EXISTS(variant of this colour with stock > 0) as a boolean column.
    Distinct ids are reduced map-side before the shuffle."""
    stocked = (variants.where(size_in_stock(F.col(stock)))
               .select(F.col("color_id").alias("_cid")).distinct()
               .withColumn("_hit", F.lit(True)))
    out = colors.join(stocked, colors["id"] == stocked["_cid"], "left")
    return out.withColumn("has_stock", F.coalesce(F.col("_hit"), F.lit(False))).drop("_cid", "_hit")


def siblings_by_product(colors: DataFrame) -> DataFrame:
    """Per product, its active colours {color_id, color_name,
    color_hex, color_slug, thumbnail} by (sort_order, id)."""
    entry = F.struct(
        F.col("sort_order"), F.col("id").alias("color_id"), "color_name", "color_hex",
        "color_slug", D.thumbnail(F.col("images")).alias("thumbnail"))
    agg = colors.where(F.col("is_active")).groupBy("product_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_c"))
    return agg.select("product_id", F.transform("_c", lambda c: F.struct(
        c["color_id"].alias("color_id"), c["color_name"].alias("color_name"),
        c["color_hex"].alias("color_hex"), c["color_slug"].alias("color_slug"),
        c["thumbnail"].alias("thumbnail"))).alias("all_colors"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """A3: per product, distinct review count, review rows, and the average
    rating rounded half-up to one place (exact, from integer sums).

    Two plain aggregates instead of ``count(distinct)``: reviews are first
    reduced per (product, review id), a shuffle on both keys that spreads a
    hot product, then per product with partial aggregation."""
    per_review = reviews.groupBy("product_id", "id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("rating").alias("_s"), F.count("rating").alias("_n"))
    agg = per_review.groupBy("product_id").agg(
        F.count("id").alias("review_count"), F.sum("_rows").alias("review_rows"),
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    tenths = D.rating_tenths(F.col("_s"), F.col("_n"))
    return agg.select("product_id", "review_count", "review_rows", tenths.alias("rating_tenths"),
                      D.rating_decimal(tenths).alias("average_rating"))


# --- the flagship (A4) ---------------------------------------------------------

CATALOG_COLUMNS = [
    "color_id", "color_slug", "color_name", "color_hex", "images", "sort_order",
    "product_id", "product_slug", "product_name", "subtitle", "price", "mrp", "badge",
    "fit_type", "description", "fabric_details", "care_instructions",
    "category_name", "category_slug", "sizes", "all_colors", "average_rating",
    "rating_tenths", "review_count", "has_stock",
]


def _catalog_core(tables, stock: str = "inventory_count") -> DataFrame:
    colors = tables["product_colors"]
    products = tables["products"]
    categories = tables["categories"]
    # Colour branch, keyed by colour id: joins the per-colour size aggregate
    # on the partitioning it already has.
    c = (colors.where(F.col("is_active"))
         .select(F.col("id").alias("color_id"), "product_id", "color_slug", "color_name",
                 "color_hex", "images", "sort_order"))
    c = c.join(sizes_by_color(tables["product_variants"], stock), "color_id", "left")
    # Product branch, keyed by product id: product and review stats share one
    # hash partitioning, so both joins reuse the colour rows' exchange.
    p = (active_products(products)
         .select(F.col("id").alias("product_id"), F.col("slug").alias("product_slug"),
                 F.col("name").alias("product_name"), "subtitle", "price", "mrp", "badge",
                 "fit_type", "description", "fabric_details", "care_instructions", "category_id"))
    cat = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"),
                            F.col("slug").alias("category_slug"))
    p = p.join(cat, "category_id", "left").drop("category_id")
    out = c.join(p, "product_id", "inner").join(review_stats(tables["reviews"]), "product_id", "left")
    # Siblings (A2/J7): the active colours of an active product are exactly
    # its catalog rows, so a window over the product partitioning the joins
    # already produced replaces a second scan and aggregate of the colours.
    entry = F.struct("sort_order", "color_id", "color_name", "color_hex", "color_slug",
                     D.thumbnail(F.col("images")).alias("thumbnail"))
    sib = F.sort_array(F.collect_list(entry).over(Window.partitionBy("product_id")))
    out = out.withColumn("all_colors", F.transform(sib, lambda e: F.struct(
        e["color_id"].alias("color_id"), e["color_name"].alias("color_name"),
        e["color_hex"].alias("color_hex"), e["color_slug"].alias("color_slug"),
        e["thumbnail"].alias("thumbnail"))))
    return out


def color_catalog(tables, stock: str = "inventory_count") -> DataFrame:
    """A4: one row per active colour of an active product."""
    out = _catalog_core(tables, stock)
    return out.select(
        *[c for c in CATALOG_COLUMNS[:19]],
        F.coalesce("sizes", F.array().cast("array<struct<variant_id:string,sku:string,size:string,"
                                           "inventory_count:bigint,in_stock:boolean>>")).alias("sizes"),
        "all_colors",
        F.coalesce("average_rating", F.lit(0).cast("decimal(20,1)")).alias("average_rating"),
        F.coalesce("rating_tenths", F.lit(0).cast("long")).alias("rating_tenths"),
        F.coalesce("review_count", F.lit(0).cast("long")).alias("review_count"),
        F.coalesce("has_stock", F.lit(False)).alias("has_stock"))


def catalog_literal(tables, stock: str = "inventory_count") -> DataFrame:
    """The view as written (Q1): its sizes array repeats each entry once
    per joined review row of the product (at least once). The repeat is kept
    as a count, ``size_repeats``, rather than materialised: the literal array
    would hold every (size, review) pair of a product. ``expand_literal_sizes``
    builds it where the output is known to be small."""
    out = _catalog_core(tables, stock)
    reps = F.greatest(F.coalesce(F.col("review_rows"), F.lit(0)), F.lit(1)).cast("long")
    sizes = F.coalesce("sizes", F.array().cast("array<struct<variant_id:string,sku:string,size:string,"
                                              "inventory_count:bigint,in_stock:boolean>>"))
    return out.select(
        "color_id", "product_id", sizes.alias("sizes"), reps.alias("size_repeats"),
        (F.size(sizes).cast("long") * reps).alias("n_sizes"),
        F.coalesce("review_count", F.lit(0).cast("long")).alias("review_count"),
        F.coalesce("rating_tenths", F.lit(0).cast("long")).alias("rating_tenths"))


def expand_literal_sizes(literal: DataFrame) -> DataFrame:
    """The view's literal sizes array: each entry ``size_repeats`` times, in
    size order. For small outputs (tests, single products) only."""
    return literal.withColumn("sizes", F.flatten(F.transform(
        "sizes", lambda s: F.array_repeat(s, F.col("size_repeats").cast("int")))))


def group_by_key(tables) -> DataFrame:
    """A5: the view's GROUP BY (colour, product, category) with dependent
    columns, done as pre-aggregate-then-join. ``joined_rows`` is count(*) of
    the literal join: max(1, variants of the colour) x max(1, reviews of the
    product)."""
    variants = tables["product_variants"].groupBy("color_id").agg(F.count(F.lit(1)).alias("_v"))
    reviews = tables["reviews"].groupBy("product_id").agg(F.count(F.lit(1)).alias("_r"))
    c = tables["product_colors"].where(F.col("is_active")).select(
        F.col("id").alias("color_id"), "product_id", "color_name")
    p = active_products(tables["products"]).select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "category_id")
    cat = tables["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    out = (c.join(variants, "color_id", "left").join(p, "product_id")
           .join(cat, "category_id", "left").join(reviews, "product_id", "left"))
    rows = (F.greatest(F.coalesce("_v", F.lit(0)), F.lit(1))
            * F.greatest(F.coalesce("_r", F.lit(0)), F.lit(1))).cast("long")
    return out.select("color_id", "product_id", "category_id", "color_name", "product_name",
                      "category_name", rows.alias("joined_rows"))


def catalog_keys(tables) -> DataFrame:
    """The key columns of the catalog rows (color_id, product_slug,
    color_slug) without computing the rows: the catalog's other joins are
    left joins on unique keys, so its rows are exactly the active colours of
    active products."""
    c = tables["product_colors"].where(F.col("is_active")).select(
        F.col("id").alias("color_id"), "product_id", "color_slug")
    p = active_products(tables["products"]).select(F.col("id").alias("product_id"),
                                                   F.col("slug").alias("product_slug"))
    return c.join(p, "product_id").select("color_id", "product_slug", "color_slug")


def catalog_counts(products: DataFrame) -> DataFrame:
    """All products and active products."""
    return products.agg(F.count(F.lit(1)).alias("all_products"),
                        F.count_if(F.col("is_active")).alias("active_products"))


# --- product read paths (R1, R2, J2-J5, G1, W1, W2, O5) -----------------------

_COLOR_ENTRY = ["id", "color_name", "color_slug", "color_hex", "images", "sort_order", "is_active"]


def product_with_colors(products: DataFrame, colors: DataFrame) -> DataFrame:
    """Every colour of each product (active or not, as the embed returns
    them) by (sort_order, id); [] when none."""
    agg = colors.groupBy("product_id").agg(F.sort_array(F.collect_list(
        F.struct(F.col("sort_order").alias("_o"), F.col("id").alias("_i"),
                 *[F.col(c) for c in _COLOR_ENTRY]))).alias("_c"))
    agg = agg.select(F.col("product_id").alias("_pid"), F.transform("_c", lambda e: F.struct(
        *[e[c].alias(c) for c in _COLOR_ENTRY])).alias("product_colors"))
    out = products.join(agg, products["id"] == agg["_pid"], "left").drop("_pid")
    empty = F.array().cast(agg.schema["product_colors"].dataType)
    return out.withColumn("product_colors", F.coalesce("product_colors", empty))


def product_category(products: DataFrame, categories: DataFrame, category: str | None = None) -> DataFrame:
    """Category name and slug; left join (product kept without a
    category), or inner join on ``lower(category) = slug`` when given."""
    cat = categories.select(F.col("id").alias("_cat_id"), F.col("name").alias("category_name"),
                            F.col("slug").alias("category_slug"))
    if category is None:
        return products.join(cat, products["category_id"] == cat["_cat_id"], "left").drop("_cat_id")
    cat = cat.where(F.col("category_slug") == F.lower(F.lit(category)))
    return products.join(cat, products["category_id"] == cat["_cat_id"], "inner").drop("_cat_id")


def category_filter(tables) -> DataFrame:
    """P4 for all categories at once: each active product under its category
    (inner join; products without a category drop out)."""
    p = active_products(tables["products"])
    cat = tables["categories"].select(F.col("id").alias("category_id"),
                                      F.col("slug").alias("category_slug"))
    return p.join(cat, "category_id", "inner").select("category_slug", F.col("id").alias("product_id"))


def for_products(tables, products: DataFrame, bounded: bool = False) -> dict:
    """The per-product inputs (colours, variants, reviews) cut down by a semi
    join to ``products`` *before* their aggregates run; Catalyst cannot push
    a filter on products into these tables. ``bounded``: ``products`` has a
    known small row count (a top-k), so its ids are broadcast."""
    ids = products.select(F.col("id").alias("product_id"))
    if bounded:
        ids = F.broadcast(ids)
    out = dict(_as_dict(tables))
    out["products"] = products
    for name in ("product_colors", "product_variants", "reviews"):
        if name in out:
            out[name] = out[name].join(ids, "product_id", "left_semi")
    return out


def _as_dict(tables) -> dict:
    names = ["products", "categories", "product_colors", "product_variants", "reviews", "sizes", "users"]
    return {n: tables[n] for n in names if n in tables}


def product_list(tables, category: str | None = None) -> DataFrame:
    """Active products with category, all colours and review stats; with
    ``category``, the other inputs are first cut to that category's products."""
    p = active_products(tables["products"])
    p = product_category(p, tables["categories"], category)
    if category is not None:
        tables = for_products(tables, p.select(*tables["products"].columns))
    p = product_with_colors(p, tables["product_colors"])
    stats = review_stats(tables["reviews"]).select(
        F.col("product_id").alias("_rid"), "review_count", "average_rating", "rating_tenths")
    p = p.join(stats, p["id"] == stats["_rid"], "left").drop("_rid")
    return (p.withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
             .withColumn("rating_tenths", F.coalesce("rating_tenths", F.lit(0).cast("long")))
             .withColumn("average_rating", F.coalesce("average_rating", F.lit(0).cast("decimal(20,1)"))))


def variants_with_size(variants: DataFrame, sizes: DataFrame) -> DataFrame:
    """J4 (inner level): each variant carries its size row (NULL when the
    label is not in the size table). No broadcast hint: AQE broadcasts the
    size table when its measured size is under the threshold."""
    s = sizes.select(F.col("label").alias("_label"), F.col("sort_order").alias("size_sort_order"))
    return variants.join(s, variants["size"] == s["_label"], "left").drop("_label")


def product_detail(tables, slug: str | None = None) -> DataFrame:
    """R2: active products with category, colours, variants (+ size row) and
    review stats; optional slug. Reviews with authors are ``reviews_with_author``."""
    p = active_products(tables["products"])
    if slug is not None:
        p = p.where(F.col("slug") == F.lit(slug))
        tables = for_products(tables, p)
    p = product_category(p, tables["categories"])
    p = product_with_colors(p, tables["product_colors"])
    v = variants_with_size(tables["product_variants"], tables["sizes"])
    ventry = F.struct(F.coalesce("size_sort_order", F.lit(0)).alias("_o"), F.col("id").alias("_i"),
                      "id", "color_id", "sku", "size", "inventory_count", "is_active", "size_sort_order")
    vagg = v.groupBy("product_id").agg(F.sort_array(F.collect_list(ventry)).alias("_v"))
    fields = ["id", "color_id", "sku", "size", "inventory_count", "is_active", "size_sort_order"]
    vagg = vagg.select(F.col("product_id").alias("_vpid"),
                       F.transform("_v", lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias("product_variants"))
    p = p.join(vagg, p["id"] == vagg["_vpid"], "left").drop("_vpid")
    p = p.withColumn("product_variants", F.coalesce("product_variants",
                                                    F.array().cast(vagg.schema["product_variants"].dataType)))
    stats = review_stats(tables["reviews"]).select(
        F.col("product_id").alias("_rid"), "review_count", "average_rating", "rating_tenths")
    p = p.join(stats, p["id"] == stats["_rid"], "left").drop("_rid")
    return (p.withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
             .withColumn("rating_tenths", F.coalesce("rating_tenths", F.lit(0).cast("long")))
             .withColumn("average_rating", F.coalesce("average_rating", F.lit(0).cast("decimal(20,1)"))))


def product_reviews(tables, slug: str | None = None) -> DataFrame:
    """R2's reviews, as rows keyed by product: each review of an active product
    with its author; one product via ``slug``. They are rows, not an array,
    because their number grows with traffic."""
    p = active_products(tables["products"])
    if slug is not None:
        p = p.where(F.col("slug") == F.lit(slug))
    p = p.select(F.col("id").alias("product_id"), F.col("slug").alias("product_slug"))
    return reviews_with_author(tables["reviews"], tables["users"]).join(p, "product_id")


def reviews_with_author(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Each review with its author's name, 'Verified Buyer' when empty."""
    u = users.select(F.col("id").alias("_uid"), F.col("full_name").alias("_fn"))
    out = reviews.join(u, reviews["user_id"] == u["_uid"], "left")
    return out.withColumn("author", D.reviewer_name(F.col("_fn"))).drop("_uid", "_fn")


def shop_cards(tables) -> DataFrame:
    """G1: one card per (product, colour) of the product list; a product with
    no colour still gets one card with its own images and plain subtitle."""
    p = product_list(tables)
    cards = p.select("*", F.posexplode_outer("product_colors").alias("color_pos", "color"))
    has_color = F.col("color").isNotNull()
    images = F.when(has_color, F.col("color.images")).otherwise(F.col("images"))
    first_color_images = F.when(has_color, F.col("color.images")).otherwise(
        F.get(F.col("product_colors"), 0)["images"])
    return cards.select(
        F.col("id").alias("product_id"), F.col("color.id").alias("color_id"),
        F.col("slug").alias("product_slug"), F.col("color.color_slug").alias("color_slug"),
        F.col("name"), F.col("badge"), F.col("fit_type"), F.col("price"),
        D.display_subtitle(F.col("subtitle"), F.col("color.color_name")).alias("subtitle"),
        D.card_image(images, first_color_images, 0).alias("image"),
        D.card_image(images, first_color_images, 1).alias("alt_image"),
        D.product_link(F.col("slug"), F.col("color.color_slug")).alias("link"))


def default_variant(tables, stock: str = "inventory_count") -> DataFrame:
    """Per colour, among active variants in size order (size sort_order,
    missing as 0; then id): the first with stock > 0, else the first, else
    none (a row of NULLs)."""
    v = variants_with_size(tables["product_variants"], tables["sizes"]).where(F.col("is_active"))
    no_stock = ~F.coalesce(size_in_stock(F.col(stock)), F.lit(False))
    rank = F.struct(no_stock, F.coalesce("size_sort_order", F.lit(0)), F.col("id"))
    first = first_by(v.where(F.col("color_id").isNotNull()), ["color_id"], rank,
                     ["id", "size", stock]).withColumnRenamed("id", "variant_id")
    # Colours of the table and colours that only variants name.
    colors = tables["product_colors"].select(F.col("id").alias("color_id")).distinct()
    return colors.join(first, "color_id", "full_outer")


def selected_color(requests: DataFrame, colors: DataFrame) -> DataFrame:
    """For each request (product_id, requested slug): the colour whose slug
    matches, else the product's first colour by (sort_order, id). Two equi-joins,
    no fan-out over the product's colours."""
    exact = first_by(colors, ["product_id", "color_slug"],
                     F.struct("sort_order", "id"), ["id"]).select(
        F.col("product_id").alias("_ep"), F.col("color_slug").alias("_es"), F.col("id").alias("_match"))
    first = first_by(colors, ["product_id"], F.struct("sort_order", "id"), ["id"]).select(
        F.col("product_id").alias("_fp"), F.col("id").alias("_first"))
    out = requests.join(exact, (requests["product_id"] == exact["_ep"])
                        & (requests["requested_slug"] == exact["_es"]), "left")
    out = out.join(first, out["product_id"] == first["_fp"], "left")
    return out.withColumn("selected_color_id", F.coalesce("_match", "_first")).drop(
        "_ep", "_es", "_match", "_fp", "_first")


def featured(tables, k: int = 4) -> DataFrame:
    """First four active products by id (top-k; the limit is the
    feature). The k ids are chosen first (a top-k over products alone), then
    only their colours and reviews are read into the aggregates."""
    top = active_products(tables["products"]).orderBy("id").limit(k)
    return product_list(for_products(tables, top, bounded=True)).orderBy("id")
