"""TESTDATA -> shop tables.

The test tables are TPC-H-like; each shop table is one SQL text over them.
The same texts prefix the DuckDB oracle (as CTEs), so both engines start from
identical rows. Everything after the fixture step is Spark DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.sources import schemas

# The fixture views, one SQL text each (FIXTURES.md). They must
# stay textually equal to the texts the oracle uses.
FIXTURE_SQL: dict[str, str] = {
    "categories": "select p_type as id, p_type as name, lower(p_type) as slug from part group by p_type",
    "products": "select p_partkey as id, concat('p-', p_partkey) as slug, p_name as name, case when p_partkey % 7 = 0 then null else p_brand end as subtitle, cast(round(p_retailprice * 100) as bigint) as price, cast(round(p_retailprice * 100) as bigint) + 10000 as mrp, case p_partkey % 3 when 0 then 'Bestseller' when 1 then 'New' end as badge, case when p_size > 25 then 'Baggy' else 'Wide-Leg' end as fit_type, concat('About ', p_name) as description, 'Cotton' as fabric_details, 'Cold wash' as care_instructions, case when p_partkey % 5 = 0 then concat('/img/p', p_partkey, '.jpeg') end as image, case when p_partkey % 11 = 0 then null else p_type end as category_id, p_partkey % 10 <> 0 as is_active from part",
    "product_colors": "select concat(l_partkey, '-', l_returnflag) as id, l_partkey as product_id, case l_returnflag when 'A' then 'Ash' when 'N' then 'Navy' else 'Rust' end as color_name, lower(l_returnflag) as color_slug, case l_returnflag when 'A' then '#b2beb5' when 'N' then '#000080' else '#b7410e' end as color_hex, case when l_partkey % 9 = 0 then null else concat('/img/', l_partkey, l_returnflag, '.jpeg') end as image, case when l_partkey % 9 = 0 or l_partkey % 4 = 0 then null else concat('/img/', l_partkey, l_returnflag, '-2.jpeg') end as image_2, case l_returnflag when 'A' then 2 when 'N' then 0 else 1 end as sort_order, (l_partkey + ascii(l_returnflag)) % 13 <> 0 as is_active from lineitem where l_partkey % 17 <> 0 group by l_partkey, l_returnflag",
    "sizes": "select label, sort_order from (values ('XS', 1), ('S', 2), ('M', 3), ('L', 4), ('XL', 5), ('XXL', 6)) as t(label, sort_order)",
    "product_variants": "select concat(l_partkey, '-', l_returnflag, '-', l_linenumber) as id, l_partkey as product_id, concat(l_partkey, '-', l_returnflag) as color_id, concat('SKU', l_partkey, l_returnflag, l_linenumber) as sku, case l_linenumber when 1 then 'XS' when 2 then 'S' when 3 then 'M' when 4 then 'L' when 5 then 'XL' when 6 then 'XXL' else 'ONE' end as size, greatest(0, cast(sum(l_quantity) as bigint) - 30) as inventory_count, (l_partkey + l_linenumber) % 8 <> 0 as is_active from lineitem where l_partkey % 17 <> 0 and (l_partkey + ascii(l_returnflag)) % 23 <> 0 group by l_partkey, l_returnflag, l_linenumber",
    "reviews": "select concat(l_orderkey, '-', l_partkey) as id, l_partkey as product_id, o_custkey as user_id, cast(substr(o_orderpriority, 1, 1) as int) as rating, o_orderdate as created_at, l_orderkey % 3 = 0 as verified_purchase from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' and l_partkey % 5 <> 0 group by l_orderkey, l_partkey, o_custkey, o_orderpriority, o_orderdate",
    "users": "select c_custkey as id, case when c_custkey % 6 = 0 then null else c_name end as full_name, concat('u', c_custkey, '@example.com') as email from customer",
    "addresses": "select o_orderkey as id, o_custkey as user_id, case when o_orderkey % 4 = 0 then 'Work' else 'Home' end as label, o_orderpriority = '1-URGENT' as is_default, o_orderdate as created_at from orders",
    "address_events": "select o_orderkey as event_id, o_custkey as user_id, o_orderkey as address_id, o_orderdate as ts from orders where o_orderkey % 10 = 0",
    "orders_t": "select o_orderkey as id, case when o_orderkey % 13 = 0 then null else o_custkey end as user_id, case o_orderstatus when 'F' then 'delivered' when 'O' then 'pending' else 'processing' end as status, cast(round(o_totalprice * 100) as bigint) as total_amount, o_orderdate as created_at, case when o_orderkey % 5 = 0 then null else concat('ORD-', o_orderkey) end as order_number, case when o_orderkey % 4 = 0 then 'express' else 'standard' end as shipping_method from orders",
    "order_items": "select l_orderkey as order_id, l_partkey as product_id, concat(l_partkey, '-', l_returnflag, '-', l_linenumber) as variant_id, cast(sum(l_quantity) as bigint) as quantity, max(cast(round(p_retailprice * 100) as bigint)) as price from lineitem join part on l_partkey = p_partkey group by l_orderkey, l_partkey, l_returnflag, l_linenumber",
    "discount_codes": "select n_nationkey as id, n_name as code, n_nationkey % 7 <> 0 as is_active, case n_nationkey % 3 when 0 then 'fixed' when 1 then 'percentage' else 'other' end as discount_type, case n_nationkey % 3 when 0 then 50000 + n_nationkey else n_nationkey + 4 end as discount_value, case when n_nationkey % 4 = 0 then null else cast('1996-01-01' as timestamp) end as starts_at, case when n_nationkey % 5 = 0 then null else cast('2000-06-30' as timestamp) end as expires_at, case n_nationkey % 6 when 0 then null when 1 then 0 else 100 end as max_uses, n_nationkey * 8 as used_count, case n_nationkey % 3 when 0 then null when 1 then 0 else 5000000 end as min_order_value from nation",
    "shipping_config": "select 10000000 as free_above, 10000 as flat_rate, 20000 as express_rate",
    "checkouts": "select o_orderkey as session_id, case when o_orderkey % 9 = 0 then 'nope' else lower(n_name) end as typed_code, o_orderdate as now_ts, case o_orderkey % 4 when 0 then 'express' when 1 then 'pickup' else 'standard' end as shipping_method from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "order_requests": "select o_orderkey as request_id, cast(round(o_totalprice * 100) as bigint) as amount, case when o_orderkey % 13 = 0 then concat('guest_', o_orderkey) when o_orderkey % 17 = 0 then '' else cast(o_custkey as string) end as customer_id, case when o_orderkey % 13 = 0 then null else o_orderkey end as address_id, case when o_orderkey % 13 = 0 then concat('Street ', o_orderkey) end as guest_line1, case when o_orderkey % 13 = 0 and o_orderkey % 2 = 0 then 'Pune' end as guest_city, case o_orderkey % 4 when 0 then 'express' when 1 then '' else null end as shipping_method, case when o_orderkey % 3 = 0 then null else 10000 end as shipping_fee from orders",
    "cart_events": "select event_id, ts, user_id as session_id, event_id % 20 as item_key, case event_type when 'click' then 'add' when 'view' then 'change' when 'signup' then 'change' when 'error' then 'remove' else case when event_id % 7 = 0 then 'clear' else 'add' end end as op, case event_type when 'view' then cast(floor(value / 10) as int) when 'signup' then -cast(floor(value / 10) as int) else 1 end as delta from events",
    "wishlist_events": "select event_id, ts, user_id, event_id % 200 as product_id, case when event_type = 'error' then 'remove' else 'add' end as op from events where event_type in ('click', 'error', 'view')",
    "payment_events": "select event_id, case when event_id % 23 = 0 then null when event_id % 19 = 0 then -event_id else event_id end as order_id, case when event_id % 6 = 0 then 'PAYMENT_FAILED_WEBHOOK' else 'PAYMENT_SUCCESS_WEBHOOK' end as type, ts from events where event_type = 'purchase'",
    "catalog_changes": "select event_id, ts, case event_type when 'click' then 'products' when 'view' then 'product_variants' when 'purchase' then 'product_colors' else 'reviews' end as table_name, case event_id % 3 when 0 then 'INSERT' when 1 then 'UPDATE' else 'DELETE' end as op, event_id % 200 as product_id from events",
}

# TESTDATA tables each fixture reads.
BASE_TABLES = ("part", "lineitem", "orders", "customer", "nation", "events")
_NAMED = re.compile(rf"\b(from|join)\s+({'|'.join(BASE_TABLES)})\b")


def _with_images(df: DataFrame, cols: list[str]) -> DataFrame:
    """Image arrays from the ``image*`` columns, NULLs dropped."""
    arr = F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull())
    return df.withColumn("images", arr).drop(*cols)


class Tables:
    """Lazily built shop tables for one TESTDATA directory.

    ``tables["products"]`` is a DataFrame; nothing is read until a query uses
    it, and Catalyst prunes the parquet columns each fixture does not touch.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A TESTDATA table, listed once for each ``Tables``: files added later
        are seen by the next one."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._base[name]

    def sql(self, text: str) -> DataFrame:
        """SQL over the base tables of this directory. The tables that the text
        names go in as DataFrames, not as session-wide views, so two
        directories in one session keep apart."""
        named = {m[1] for m in _NAMED.findall(text)}
        quoted = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_NAMED.sub(r"\1 {\2}", quoted), **{n: self.base(n) for n in named})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self.sql(FIXTURE_SQL[name])
            if name == "products":
                df = _with_images(df, ["image"])
            elif name == "product_colors":
                df = _with_images(df, ["image", "image_2"])
            self._cache[name] = schemas.conform(df, name)
        return self._cache[name]

    def __contains__(self, name: str) -> bool:
        return name in FIXTURE_SQL


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
