"""Oracle SQL: for each registered key, DuckDB SQL over the TESTDATA tables.

Written from the rules, not from the Spark code. The fixture views are the
only shared part: they prefix each text as CTEs.
"""

from __future__ import annotations

from colorway.sources.fixtures import FIXTURE_SQL

ORACLE: dict[str, str] = {}


def oracle(name: str, uses: list[str], body: str, recursive: bool = False) -> None:
    ctes = ", ".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in uses)
    body = body.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    # A body may open with ", extra AS (...)" to add its own CTEs.
    ORACLE[name] = f"{head} {ctes}{body}" if body.startswith(",") else f"{head} {ctes} {body}"


# The order of size labels; other labels rank 99.
RANK = ("case {v}.size when 'XS' then 1 when 'S' then 2 when 'M' then 3 when 'L' then 4 "
        "when 'XL' then 5 when 'XXL' then 6 else 99 end")
SIZE_ENTRY = ("concat_ws(':', {v}.id, {v}.sku, {v}.size, cast({v}.inventory_count as varchar), "
              "cast({v}.inventory_count > 0 as varchar))")
SIB_ENTRY = "concat_ws(':', {c}.id, {c}.color_name, {c}.color_hex, {c}.color_slug, coalesce({c}.image, {c}.image_2))"
TENTHS = ("cast(case when count({r}.rating) = 0 then 0 else (20 * sum({r}.rating) + count({r}.rating)) "
          "// (2 * count({r}.rating)) end as bigint)")


def _sizes_sub(pc: str) -> str:
    return (f"coalesce((select string_agg({SIZE_ENTRY.format(v='v')}, '|' order by {RANK.format(v='v')}, v.id) "
            f"from product_variants v where v.color_id = {pc}.id), '')")


def _sib_sub(pc: str) -> str:
    return (f"(select string_agg({SIB_ENTRY.format(c='c2')}, '|' order by c2.sort_order, c2.id) "
            f"from product_colors c2 where c2.product_id = {pc}.product_id and c2.is_active)")


# --- sources / projections / predicates ----------------------------------------

oracle("scan_table", ["products"], """
select concat('prod-', id) as id, slug, name, subtitle, price, mrp, badge, fit_type, description, fabric_details,
       care_instructions, category_id, is_active, coalesce(image, '') as images from products""")

oracle("project_columns", ["products"], "select id, name, is_active, category_id from products")

oracle("active_products", ["products"], "select id, slug, price from products where is_active")

oracle("active_pairs", ["products", "product_colors"], """
select c.id as color_id, c.product_id, c.color_slug, p.slug as product_slug
from product_colors c join products p on p.id = c.product_id where c.is_active and p.is_active""")

oracle("category_filter", ["products", "categories"], """
select c.slug as category_slug, p.id as product_id
from products p join categories c on c.id = p.category_id where p.is_active""")

oracle("size_in_stock", ["product_variants"],
       "select id as variant_id, inventory_count > 0 as in_stock from product_variants")

# --- joins ---------------------------------------------------------------------

oracle("color_product", ["products", "product_colors"], """
select c.id as color_id, c.product_id, p.slug as product_slug, c.color_name
from product_colors c join products p on p.id = c.product_id""")

oracle("product_category", ["products", "categories"], """
select p.id as product_id, c.name as category_name, c.slug as category_slug
from products p left join categories c on c.id = p.category_id""")

oracle("product_with_colors", ["products", "product_colors"], """
select p.id as product_id,
  coalesce((select string_agg(concat_ws(':', c.id, c.color_slug, cast(c.sort_order as varchar)), '|'
            order by c.sort_order, c.id) from product_colors c where c.product_id = p.id), '') as colors,
  (select count(*) from product_colors c where c.product_id = p.id) as n_colors
from products p""")

oracle("variants_with_size", ["product_variants", "sizes"], """
select v.id as variant_id, v.size, s.sort_order as size_sort_order
from product_variants v left join sizes s on s.label = v.size""")

oracle("reviews_with_author", ["reviews", "users"], """
select r.id as review_id, r.product_id, r.rating,
  coalesce(nullif(u.full_name, ''), 'Verified Buyer') as author, r.verified_purchase
from reviews r left join users u on u.id = r.user_id""")

oracle("color_has_stock", ["product_colors", "product_variants"], """
select c.id as color_id,
  exists (select 1 from product_variants v where v.color_id = c.id and v.inventory_count > 0) as has_stock
from product_colors c""")

oracle("sibling_colors", ["product_colors"], f"""
select pc.id as color_id, {_sib_sub('pc')} as all_colors from product_colors pc""")

oracle("catalog_literal", ["products", "product_colors", "categories", "product_variants", "reviews"], f"""
select pc.id as color_id, p.id as product_id,
  {_sizes_sub('pc')} as sizes,
  count(*) // greatest(count(distinct v.id), 1) as size_repeats,
  count(v.id) as n_sizes,
  count(distinct r.id) as review_count,
  {TENTHS.format(r='r')} as rating_tenths
from product_colors pc
join products p on p.id = pc.product_id
left join categories c on c.id = p.category_id
left join product_variants v on v.color_id = pc.id
left join reviews r on r.product_id = p.id
where p.is_active and pc.is_active
group by pc.id, p.id""")

# --- aggregations ----------------------------------------------------------------

oracle("sizes_by_color", ["product_variants"], f"""
select v.color_id, string_agg({SIZE_ENTRY.format(v='v')}, '|' order by {RANK.format(v='v')}, v.id) as sizes,
  count(*) as n_sizes, bool_or(coalesce(v.inventory_count > 0, false)) as has_stock
from product_variants v where v.color_id is not null group by v.color_id""")

oracle("siblings_by_product", ["product_colors"], f"""
select c.product_id, string_agg({SIB_ENTRY.format(c='c')}, '|' order by c.sort_order, c.id) as all_colors
from product_colors c where c.is_active group by c.product_id""")

oracle("review_stats", ["reviews"], f"""
select r.product_id, count(distinct r.id) as review_count, {TENTHS.format(r='r')} as rating_tenths
from reviews r group by r.product_id""")

_CATALOG_USES = ["products", "product_colors", "categories", "product_variants", "reviews"]
_CATALOG = f"""
select pc.id as color_id, pc.color_slug, pc.color_name, pc.color_hex, pc.sort_order,
  p.id as product_id, p.slug as product_slug, p.name as product_name, p.subtitle, p.price, p.mrp,
  p.badge, p.fit_type, p.description, p.fabric_details, p.care_instructions,
  c.name as category_name, c.slug as category_slug,
  coalesce((select {TENTHS.format(r='r')} from reviews r where r.product_id = p.id), 0) as rating_tenths,
  (select count(distinct r.id) from reviews r where r.product_id = p.id) as review_count,
  exists (select 1 from product_variants v2 where v2.color_id = pc.id and v2.inventory_count > 0) as has_stock,
  concat_ws(',', pc.image, pc.image_2) as images,
  {_sizes_sub('pc')} as sizes,
  {_sib_sub('pc')} as all_colors
from product_colors pc
join products p on p.id = pc.product_id
left join categories c on c.id = p.category_id
where p.is_active and pc.is_active"""
oracle("color_catalog", _CATALOG_USES, _CATALOG)

oracle("catalog_stored", _CATALOG_USES, """
, pv as (select id, color_id, sku, size, greatest(inventory_count - 5, 0) as inventory_count from product_variants)
""" + _CATALOG.replace("product_variants v", "pv v").replace("p.id as product_id", "concat('prod-', p.id) as product_id"))

oracle("group_by_key", ["products", "product_colors", "categories", "product_variants", "reviews"], """
select pc.id as color_id, p.id as product_id, p.category_id, pc.color_name, p.name as product_name,
  c.name as category_name, count(*) as joined_rows
from product_colors pc
join products p on p.id = pc.product_id
left join categories c on c.id = p.category_id
left join product_variants v on v.color_id = pc.id
left join reviews r on r.product_id = p.id
where p.is_active and pc.is_active
group by pc.id, p.id, p.category_id, pc.color_name, p.name, c.name""")

oracle("catalog_counts", ["products"], """
select count(*) as all_products, count(*) filter (where is_active) as active_products from products""")

# --- pick-one rules, orders, rows ---------------------------------------------

oracle("default_variant", ["product_variants", "sizes", "product_colors"], """
select coalesce(c.id, t.color_id) as color_id, variant_id, size from (
  select v.color_id, v.id as variant_id, v.size,
    row_number() over (partition by v.color_id
      order by case when v.inventory_count > 0 then 0 else 1 end, coalesce(s.sort_order, 0), v.id) as rn
  from product_variants v left join sizes s on s.label = v.size
  where v.is_active and v.color_id is not null qualify rn = 1) t
full join (select distinct id from product_colors) c on c.id = t.color_id""")

oracle("selected_color", ["order_items", "product_variants", "product_colors", "products"], """
, req as (
  select i.order_id, i.variant_id, i.product_id, c.color_slug as requested_slug
  from order_items i left join product_variants v on v.id = i.variant_id
  left join product_colors c on c.id = v.color_id),
exact as (
  select product_id, color_slug, first(id order by sort_order, id) as cid
  from product_colors group by product_id, color_slug),
firsts as (
  select product_id, first(id order by sort_order, id) as cid from product_colors group by product_id)
select s.*, coalesce(sc.image, sc.image_2, p.image) as image from (
  select r.order_id, r.variant_id, r.product_id, r.requested_slug, coalesce(e.cid, f.cid) as selected_color_id
  from req r left join exact e on e.product_id = r.product_id and e.color_slug = r.requested_slug
  left join firsts f on f.product_id = r.product_id) s
left join product_colors sc on sc.id = s.selected_color_id
left join products p on p.id = s.product_id""")

oracle("size_rank", ["product_variants"], f"""
select v.id as variant_id, v.size, {RANK.format(v='v')} as size_rank from product_variants v""")

oracle("variant_order", ["product_variants", "sizes"], """
select v.id as variant_id, v.product_id,
  row_number() over (partition by v.product_id order by coalesce(s.sort_order, 0), v.id) as position
from product_variants v left join sizes s on s.label = v.size""")

oracle("featured", ["products"], """
select id as product_id, slug, name from products where is_active order by id limit 4""")

oracle("shop_cards", ["products", "product_colors"], """
select p.id as product_id, c.id as color_id, p.slug as product_slug, c.color_slug, p.name, p.badge, p.fit_type, p.price,
  case when c.id is null then p.subtitle else concat_ws(' · ', nullif(p.subtitle, ''), c.color_name) end as subtitle,
  case when c.id is null then p.image else coalesce(c.image, c.image_2) end as image,
  case when c.id is null then null else list_filter([c.image, c.image_2], lambda x: x is not null)[2] end as alt_image,
  case when c.color_slug is not null and c.color_slug <> '' then concat('/product/', p.slug, '?color=', c.color_slug)
       else concat('/product/', p.slug) end as link
from products p left join product_colors c on c.product_id = p.id where p.is_active""")

oracle("product_list", ["products", "categories", "product_colors", "reviews"], f"""
, rs as (select r.product_id, count(distinct r.id) as review_count, {TENTHS.format(r='r')} as rating_tenths
         from reviews r group by r.product_id)
select p.id as product_id, p.slug, p.name, p.subtitle, p.price, p.mrp, p.badge, p.fit_type,
  c.name as category_name, c.slug as category_slug,
  coalesce((select string_agg(concat_ws(':', pc.id, pc.color_slug), '|' order by pc.sort_order, pc.id)
            from product_colors pc where pc.product_id = p.id), '') as colors,
  coalesce(rs.review_count, 0) as review_count, coalesce(rs.rating_tenths, 0) as rating_tenths
from products p left join categories c on c.id = p.category_id left join rs on rs.product_id = p.id
where p.is_active""")

oracle("product_detail", ["products", "categories", "product_colors", "product_variants", "sizes", "reviews"], f"""
, rs as (select r.product_id, count(distinct r.id) as review_count, {TENTHS.format(r='r')} as rating_tenths
         from reviews r group by r.product_id)
select p.id as product_id, p.slug, c.slug as category_slug,
  coalesce((select string_agg(pc.id, '|' order by pc.sort_order, pc.id)
            from product_colors pc where pc.product_id = p.id), '') as colors,
  coalesce((select string_agg(concat_ws(':', v.id, v.size, cast(s.sort_order as varchar)), '|'
                              order by coalesce(s.sort_order, 0), v.id)
            from product_variants v left join sizes s on s.label = v.size where v.product_id = p.id), '') as variants,
  coalesce(rs.review_count, 0) as review_count, coalesce(rs.rating_tenths, 0) as rating_tenths,
  printf('%d.%d', coalesce(rs.rating_tenths, 0) // 10, coalesce(rs.rating_tenths, 0) % 10) as average_rating
from products p left join categories c on c.id = p.category_id left join rs on rs.product_id = p.id
where p.is_active""")

oracle("scan_review_aggregates", ["reviews"], f"""
, t as (select r.product_id, count(distinct r.id) as review_count, {TENTHS.format(r='r')} as tenths from reviews r group by r.product_id)
select concat('prod-', product_id) as product_id, review_count, printf('%d.%d', tenths // 10, tenths % 10) as average_rating from t""")

oracle("product_reviews", ["products", "reviews", "users"], """
select p.id as product_id, p.slug as product_slug, r.id as review_id,
  coalesce(nullif(u.full_name, ''), 'Verified Buyer') as author, r.rating, r.verified_purchase
from products p join reviews r on r.product_id = p.id left join users u on u.id = r.user_id where p.is_active""")

# --- scalar rules on the catalog -----------------------------------------------

oracle("display_subtitle", ["products", "product_colors"], """
select p.id as product_id, c.id as color_id,
  case when c.color_name is null then p.subtitle
       else concat_ws(' · ', nullif(p.subtitle, ''), c.color_name) end as display_subtitle
from products p left join product_colors c on c.product_id = p.id""")

oracle("card_images", ["products", "product_colors"], """
, fc as (select product_id, first(list_filter([image, image_2], lambda x: x is not null) order by sort_order, id) as imgs
         from product_colors group by product_id)
select p.id as product_id, coalesce(p.image, fc.imgs[1]) as image, fc.imgs[2] as alt_image
from products p left join fc on fc.product_id = p.id where p.is_active""")

oracle("thumbnails", ["product_colors"],
       "select id as color_id, coalesce(image, image_2) as thumbnail from product_colors")

oracle("rating_display", ["reviews"], f"""
, t as (select r.product_id, {TENTHS.format(r='r')} as tenths from reviews r group by r.product_id)
select product_id, printf('%d.%d', tenths // 10, tenths % 10) as average_rating,
  cast((tenths + 5) // 10 as integer) as stars from t""")

oracle("product_links", ["products", "product_colors"], """
select p.id as product_id, c.id as color_id,
  case when c.color_slug is not null and c.color_slug <> '' then concat('/product/', p.slug, '?color=', c.color_slug)
       else concat('/product/', p.slug) end as link
from products p left join product_colors c on c.product_id = p.id""")

oracle("sizes_json", ["product_variants"], f"""
select v.color_id, cast(to_json(list(struct_pack(variant_id := v.id, sku := v.sku, size := v.size,
    inventory_count := v.inventory_count, in_stock := v.inventory_count > 0)
    order by {RANK.format(v='v')}, v.id)) as varchar) as sizes_json
from product_variants v where v.color_id is not null group by v.color_id""")


def oracle_sql() -> dict[str, str]:
    # The state texts reuse the order and cart texts, so they load last.
    from colorway.plans import account_oracle, checkout_oracle, order_oracle  # noqa: F401
    from colorway.plans import state_oracle  # noqa: F401
    return dict(ORACLE)
