"""Per-batch rules of the stream jobs; each works on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables the client's change feed listens to, and tables whose
# changes refresh the catalog view.
FEED_TABLES = ("products", "product_variants")
CATALOG_TABLES = ("products", "product_colors", "product_variants")


def affected_keys(changes: DataFrame, tables=FEED_TABLES) -> DataFrame:
    """Distinct product ids whose results are stale. A changed row may
    move between products, so both the new and the old product id count."""
    c = changes.where(F.col("table_name").isin(*tables))
    ids = [F.col("product_id")]
    if "old_product_id" in changes.columns:
        ids.append(F.col("old_product_id"))
    return (c.select(F.explode(F.array(*ids)).alias("product_id"))
             .where(F.col("product_id").isNotNull()).distinct())
