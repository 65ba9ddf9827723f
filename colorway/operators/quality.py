"""Schema migration, integrity checks and cascades as whole-table jobs
(SURVEY D7-D12). Each check is one aggregation pass; violations are reported,
never repaired silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colorway.session import range_partitions

# The columns the colour-first migration drops from variants.
LEGACY_VARIANT_COLUMNS = ["color", "color_hex", "images"]


def variants_migrate(variants: DataFrame) -> DataFrame:
    """Drop color, color_hex, images if present; add color_id if absent
    (NULL: the migration does not backfill)."""
    out = variants.drop(*[c for c in LEGACY_VARIANT_COLUMNS if c in variants.columns])
    if "color_id" not in out.columns:
        out = out.withColumn("color_id", F.lit(None).cast("string"))
    return out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their count (partial counts are
    combined before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


# The checks of D8.
KEY_CHECKS = ("colors_product_slug", "catalog_color_id", "catalog_slugs", "cart_session_variant")
# Bytes of the tables read for each task that counts keys.
KEY_SOURCE_BYTES = 16 * 1024 * 1024


def key_checks(tables) -> DataFrame:
    """Uniqueness of (product_id, color_slug) among colours, of color_id
    and (product_slug, color_slug) in the catalog, and of a cart's
    (session, variant) (order lines by order). One row per check with the
    number of duplicated keys.

    Each table is read once: a colour gives its own key and, for every active
    product row it belongs to (the catalog's rows are the active colours of
    active products), its two catalog keys. All keys of all checks are then
    dealt by (check, key) to tasks whose number follows the tables' size,
    counted there, and the checks by one aggregate more. A check goes as its
    place in KEY_CHECKS."""
    by_color, in_catalog, by_slugs, by_cart = KEY_CHECKS

    def key(check: str, first: str, second) -> Column:
        return F.struct(F.lit(KEY_CHECKS.index(check)).alias("check"), F.col(first).cast("string").alias("a"),
                        (second if second is not None else F.lit(None)).cast("string").alias("b"))

    slugs = tables["products"].where(F.col("is_active")).groupBy(F.col("id").alias("product_id")) \
        .agg(F.collect_list(F.struct(F.col("slug").cast("string").alias("slug"))).alias("_slugs"))  # one, unless an id repeats
    colors = tables["product_colors"].select("id", "product_id", "color_slug", "is_active").join(slugs, "product_id", "left")
    rows = F.filter(F.coalesce("_slugs", F.array().cast("array<struct<slug:string>>")), lambda s: F.col("is_active"))
    of_color = F.concat(
        F.array(key(by_color, "product_id", F.col("color_slug"))),
        F.transform(rows, lambda s: key(in_catalog, "id", None)),
        F.transform(rows, lambda s: F.struct(F.lit(KEY_CHECKS.index(by_slugs)).alias("check"), s["slug"].alias("a"), F.col("color_slug").cast("string").alias("b"))))
    keys = colors.select(F.explode(of_color).alias("k")).select("k.*").unionByName(
        tables["order_items"].select(key(by_cart, "order_id", F.col("variant_id")).alias("k")).select("k.*"))
    # keys are nearly all distinct: counting them before the shuffle as well would only hold them twice
    keys = keys.repartition(range_partitions(keys, bytes_each=KEY_SOURCE_BYTES), "check", "a", "b")
    twice = keys.groupBy("check", "a", "b").agg((F.count(F.lit(1)) > 1).alias("twice"))
    counts = twice.agg(*[F.count_if(F.col("twice") & (F.col("check") == k)).alias(c) for k, c in enumerate(KEY_CHECKS)])
    return counts.unpivot([], list(KEY_CHECKS), "check", "violations")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent (anti join)."""
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def reference_checks(tables) -> DataFrame:
    """Orphan colours (no product) and orphan variants (no colour)."""
    checks = [
        ("color_product", orphans(tables["product_colors"], "product_id", tables["products"])),
        ("variant_color", orphans(tables["product_variants"], "color_id", tables["product_colors"])),
    ]
    return reduce(DataFrame.unionByName, [
        d.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check"), "orphans")
        for name, d in checks])


def cascade_delete(tables, product_ids: DataFrame) -> dict[str, DataFrame]:
    """Deleting products removes their colours and those colours'
    variants (chained anti joins)."""
    ids = product_ids.select(F.col("id")).distinct()
    products = tables["products"].join(ids, "id", "left_anti")
    gone_colors = tables["product_colors"].join(ids.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    colors = tables["product_colors"].join(ids.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    variants = tables["product_variants"].join(
        gone_colors.select(F.col("id").alias("color_id")), "color_id", "left_anti")
    return {"products": products, "product_colors": colors, "product_variants": variants}


# Columns that must hold a value (declared NOT NULL, or keys and
# amounts the code always writes). Owner columns of addresses and orders may
# be NULL (guest checkout).
REQUIRED = {
    "products": ["id", "slug", "name", "price", "is_active"],
    "product_colors": ["id", "product_id", "color_name", "color_slug", "color_hex", "images", "sort_order",
                       "is_active", "created_at", "updated_at"],
    "product_variants": ["id", "product_id", "sku", "size"],
    "addresses": ["id", "label", "created_at"],
    "orders_t": ["id", "status", "total_amount", "created_at"],
}


def null_checks(df: DataFrame, table: str) -> DataFrame:
    """NULL count of every column in one aggregation pass, as rows
    (table, column, nulls, required, violation). A required column that the
    table lacks is a violation with NULL nulls."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    req = REQUIRED.get(table, [])
    out = one.unpivot([], df.columns, "column", "nulls").select(
        F.lit(table).alias("table"), "column", "nulls", F.col("column").isin(*req).alias("required"))
    absent = [c for c in req if c not in df.columns]
    if absent:
        gone = df.sparkSession.createDataFrame([(table, c, None, True) for c in absent],
                                               "table string, column string, nulls long, required boolean")
        out = out.unionByName(gone)
    return out.withColumn("violation", F.col("required") & (F.col("nulls").isNull() | (F.col("nulls") > 0)))


def color_defaults(colors: DataFrame, load_time) -> DataFrame:
    """Insert defaults on new colours: images [], sort_order 0, active,
    created/updated at the load time (a parameter, not the clock)."""
    ts = F.lit(load_time).cast("timestamp_ntz")
    out = colors
    for c, default in [("images", F.array().cast("array<string>")), ("sort_order", F.lit(0)),
                       ("is_active", F.lit(True)), ("created_at", ts), ("updated_at", ts)]:
        out = out.withColumn(c, F.coalesce(F.col(c), default) if c in colors.columns else default)
    return out
