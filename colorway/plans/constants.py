"""Constants shared by registered queries and their oracles."""

# Fixed value: load time written into new colours by the registered D12 query.
LOAD_TIME = "2024-01-01 00:00:00"

# Fixed value: tables the registered D11 query checks.
NULL_CHECK_TABLES = ["products", "product_colors", "product_variants", "addresses", "orders_t"]
