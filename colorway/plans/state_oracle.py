"""Oracle texts: carts, data checks, sinks and stream bodies."""

from __future__ import annotations

from colorway.plans.constants import LOAD_TIME
from colorway.plans import checkout_oracle  # noqa: F401 - its texts are reused here
from colorway.plans.oracle import ORACLE, oracle


# --- carts -----------------------------------------------------------------------

oracle("cart_state", ["cart_events"], """
, k as (select distinct session_id, item_key from cart_events where op <> 'clear'),
ev as (
  select e.session_id, e.item_key, e.ts, e.event_id, e.op, e.delta from cart_events e where e.op <> 'clear'
  union all
  select k.session_id, k.item_key, e.ts, e.event_id, e.op, e.delta
  from k join cart_events e on e.session_id = k.session_id where e.op = 'clear'),
seq as (select *, row_number() over (partition by session_id, item_key order by ts, event_id) as rn from ev),
rec as (
  select session_id, item_key, cast(0 as bigint) as rn, cast(0 as bigint) as q from k
  union all
  select r.session_id, r.item_key, s.rn,
    case s.op when 'add' then case when r.q = 0 then 1 else least(20, r.q + 1) end
              when 'change' then case when r.q = 0 then 0 else greatest(1, least(20, r.q + coalesce(s.delta, 0))) end
              else 0 end
  from rec r join seq s on s.session_id = r.session_id and s.item_key = r.item_key and s.rn = r.rn + 1)
select session_id, item_key, cast(arg_max(q, rn) as bigint) as qty from rec group by session_id, item_key
having arg_max(q, rn) > 0""", recursive=True)

oracle("cart_sessions", ["cart_events", "users"], """
, ex as (select session_id as user_id, min(cast(session_id as varchar)) as sid from cart_events group by session_id)
select user_id, sid as session_id, false as created from ex
union all
select id as user_id, sha256(concat('cart:', cast(id as varchar))) as session_id, true as created
from users where id not in (select user_id from ex where user_id is not null)""")

# --- data checks -----------------------------------------------------------------

oracle("variants_migrate", ["product_variants"],
       "select id, sku, cast(null as varchar) as color_id from product_variants")

# The tables with flaws: rows entered twice, rows whose parent is gone.
_FLAWED = """
, colors as (select id, product_id, color_slug, is_active from product_colors
  union all select id, product_id, color_slug, is_active from product_colors where product_id % 10 = 3
  union all select concat(id, '-lost'), product_id + 100000000, color_slug, is_active from product_colors where product_id % 20 = 5),
variants as (select id, case when product_id % 25 = 4 then concat(color_id, '-gone') else color_id end as color_id from product_variants),
items as (select order_id, variant_id from order_items union all select order_id, variant_id from order_items where order_id % 50 = 7),
prods as (select id, case when id % 15 <> 14 then slug end as slug, is_active from products)"""

oracle("key_checks", ["products", "product_colors", "product_variants", "order_items"], _FLAWED + """,
cat as (select pc.id as color_id, p.slug as product_slug, pc.color_slug
        from colors pc join prods p on p.id = pc.product_id where pc.is_active and p.is_active)
select 'colors_product_slug' as "check", (select count(*) from (select product_id, color_slug from colors
   group by 1, 2 having count(*) > 1)) as violations
union all select 'catalog_color_id', (select count(*) from (select color_id from cat group by 1 having count(*) > 1))
union all select 'catalog_slugs', (select count(*) from (select product_slug, color_slug from cat group by 1, 2 having count(*) > 1))
union all select 'cart_session_variant', (select count(*) from (select order_id, variant_id from items
   group by 1, 2 having count(*) > 1))""")

oracle("reference_checks", ["products", "product_colors", "product_variants", "order_items"], _FLAWED + """
select 'color_product' as "check", (select count(*) from colors c where c.product_id is not null
   and not exists (select 1 from products p where p.id = c.product_id)) as orphans
union all select 'variant_color', (select count(*) from variants v where v.color_id is not null
   and not exists (select 1 from colors c where c.id = v.color_id))""")

oracle("cascade_delete", ["products", "product_colors", "product_variants"], """
, gone as (select id from products where not is_active),
gc as (select id from product_colors where product_id in (select id from gone))
select 'products' as "table", cast(id as varchar) as key from products where id not in (select id from gone)
union all select 'product_colors', id from product_colors where product_id not in (select id from gone)
union all select 'product_variants', id from product_variants where color_id is null or color_id not in (select id from gc)""")

oracle("color_defaults", ["product_colors"], f"""
select id as color_id, coalesce(sort_order, 0) as sort_order, coalesce(is_active, true) as is_active,
  cast(image is not null as bigint) + cast(image_2 is not null as bigint) as n_images, '{LOAD_TIME}' as created_at
from product_colors""")

oracle("affected_keys", ["catalog_changes"], """
select distinct product_id from catalog_changes
where table_name in ('products', 'product_variants') and product_id is not null""")


# Each table's columns; a "!" marks those that must hold a
# value, "+" those that must exist but do not.
_COLUMNS = {
    "products": "id! slug! name! subtitle price! mrp badge fit_type description fabric_details care_instructions category_id is_active! images",
    "product_colors": "id! product_id! color_name! color_slug! color_hex! sort_order! is_active! images! created_at+ updated_at+",
    "product_variants": "id! product_id! color_id sku! size! inventory_count is_active",
    "addresses": "id! user_id label! is_default created_at!",
    "orders_t": "id! user_id status! total_amount! created_at! order_number shipping_method",
}
_HOLES = {"name": 9, "slug": 14, "subtitle": 3}  # product ids modulo 15 that lack the column


def _null_check_sql() -> str:
    parts = []
    for table, names in _COLUMNS.items():
        for name in names.split():
            column, required = name.rstrip("!+"), str(name[-1] in "!+").lower()
            null = "false" if column == "images" else f"{column} is null"
            if table == "products" and column in _HOLES:
                null += f" or id % 15 = {_HOLES[column]}"
            extra = ""
            if table == "product_colors":  # entered twice, and once more for products that are gone
                extra = " + ".join(f"count(*) filter (where ({null}) and {w})" for w in ("product_id % 10 = 3", "product_id % 20 = 5"))
                extra = " + " + extra
            nulls = "cast(null as bigint)" if name[-1] == "+" else f"count(*) filter (where {null}){extra}"
            violation = "true" if name[-1] == "+" else f"{required} and {nulls} > 0"
            parts.append(f"select '{table}' as \"table\", '{column}' as \"column\", {nulls} as nulls, "
                         f"{required} as required, {violation} as violation from {'(select 1) t' if name[-1] == '+' else table}")
    return " union all ".join(parts)


oracle("null_checks", list(_COLUMNS), _null_check_sql())

# --- sinks and stream bodies: each must equal its batch counterpart -------------


ORACLE["catalog_sink"] = ORACLE["color_catalog"]
ORACLE["catalog_refresh"] = ORACLE["color_catalog"]
ORACLE["append_rows"] = ORACLE["order_build"]
ORACLE["cart_state_stream"] = ORACLE["cart_state"]
ORACLE["cart_lines_stream"] = ORACLE["cart_lines"]
ORACLE["orders_paid_stream"] = ORACLE["orders_paid"]

oracle("change_feed", ["catalog_changes"],
       "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, table_name, op, product_id from catalog_changes")
