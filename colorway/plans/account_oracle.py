"""Oracle texts: accounts."""

from __future__ import annotations

from colorway.plans.oracle import oracle


# --- accounts ------------------------------------------------------------------

oracle("address_book", ["addresses"], """
select user_id, id as address_id,
  row_number() over (partition by user_id order by is_default desc nulls first, created_at desc nulls first, id) as position
from addresses where user_id is not null""")

oracle("default_address", ["addresses"], """
select user_id, coalesce(
  first(id order by created_at desc nulls first, id) filter (where is_default),
  first(id order by case when is_default is null then 0 when is_default then 1 else 2 end,
                    created_at desc nulls first, id)) as address_id
from addresses where user_id is not null group by user_id""")

oracle("address_default_state", ["addresses", "address_events"], """
, last as (select user_id, first(address_id order by ts desc, event_id desc) as last_id
           from address_events group by user_id)
select a.id as address_id, a.user_id,
  case when l.last_id is null then a.is_default else a.id = l.last_id end as is_default
from addresses a left join last l on l.user_id = a.user_id""")

oracle("address_upsert", ["addresses", "address_events"], """
, ch as (
  select address_id as id, user_id, 'Updated' as label, false as is_default, ts as created_at from address_events
  union all
  select -event_id as id, user_id, 'New' as label, false as is_default, ts as created_at from address_events)
select coalesce(c.id, a.id) as id,
  case when c.id is not null then c.user_id else a.user_id end as user_id,
  case when c.id is not null then c.label else a.label end as label,
  case when c.id is not null then c.is_default else a.is_default end as is_default,
  strftime(case when c.id is not null then c.created_at else a.created_at end, '%Y-%m-%d %H:%M:%S') as created_at
from addresses a full outer join ch c on c.id = a.id""")

oracle("address_delete", ["addresses", "address_events"], """
select id, user_id from addresses where id not in (select address_id from address_events where address_id is not null)""")

oracle("status_band", ["orders_t"], """
select case status when 'delivered' then 'delivered' when 'processing' then 'processing' else 'other' end as band,
  count(*) as orders from orders_t group by 1""")

oracle("orders_with_items", ["orders_t", "order_items"], """
, agg as (select order_id, count(*) as lines, cast(sum(quantity) as bigint) as quantity,
                 cast(sum(quantity * price) as bigint) as items_total,
                 string_agg(concat_ws(':', variant_id, cast(quantity as varchar), cast(price as varchar)), '|'
                            order by variant_id, quantity, price) as items
          from order_items group by order_id)
select o.id as order_id, coalesce(a.lines, 0) as lines, coalesce(a.quantity, 0) as quantity,
  coalesce(a.items_total, 0) as items_total, coalesce(a.items, '') as items
from orders_t o left join agg a on a.order_id = o.id""")

oracle("order_history", ["orders_t", "order_items"], """
, agg as (select order_id, count(*) as lines, cast(sum(quantity * price) as bigint) as items_total
          from order_items group by order_id)
select o.user_id, o.id as order_id,
  row_number() over (partition by o.user_id order by o.created_at desc nulls first, o.id) as position,
  coalesce(nullif(o.order_number, ''), left(cast(o.id as varchar), 8)) as label,
  upper(o.status) as status_label, strftime(o.created_at, '%Y-%m-%d') as order_date,
  coalesce(a.lines, 0) as lines, coalesce(a.items_total, 0) as items_total
from orders_t o left join agg a on a.order_id = o.id where o.user_id is not null""")

oracle("order_labels", ["orders_t"], """
select id as order_id, coalesce(nullif(order_number, ''), left(cast(id as varchar), 8)) as label,
  upper(status) as status_label, strftime(created_at, '%Y-%m-%d') as order_date from orders_t""")

_WISH = """
, w as (select user_id, product_id from (
          select user_id, product_id, first(op order by ts desc, event_id desc) as last_op
          from wishlist_events group by user_id, product_id) where last_op = 'add')
"""

oracle("wishlist_state", ["wishlist_events"], _WISH + "select user_id, product_id from w")

oracle("wishlist_flag", ["wishlist_events"], _WISH + """
select p.user_id, p.product_id, (w.user_id is not null) as wishlisted
from (select distinct user_id, product_id from wishlist_events) p
left join w on w.user_id is not distinct from p.user_id and w.product_id is not distinct from p.product_id""")

oracle("id_in_list", ["wishlist_events", "products"], _WISH + """
select id as product_id from products where id in (select product_id from w)""")

oracle("wishlist_details", ["wishlist_events", "products", "categories", "product_colors", "reviews"], _WISH + """
, rs as (select product_id, cast((20 * sum(rating) + count(rating)) // (2 * count(rating)) as bigint) as t
         from reviews group by product_id having count(rating) > 0)
select w.user_id, w.product_id, c.slug as category_slug,
  (select count(*) from product_colors pc where pc.product_id = p.id) as n_colors,
  coalesce(rs.t, 0) as rating_tenths
from w join products p on p.id = w.product_id and p.is_active
left join categories c on c.id = p.category_id left join rs on rs.product_id = p.id""")

oracle("user_labels", ["users"], """
select id as user_id, coalesce(nullif(full_name, ''), email) as display_name,
  coalesce(nullif(full_name, ''), 'Not provided') as profile_name, 'Not provided' as phone from users""")

oracle("order_item_details", ["order_items", "product_variants", "product_colors", "products"], """
select i.order_id, i.variant_id, i.quantity, i.price, p.name as product_name, p.slug as product_slug, v.size, c.color_name,
  coalesce(c.image, c.image_2, p.image) as image
from order_items i left join product_variants v on v.id = i.variant_id
left join product_colors c on c.id = v.color_id left join products p on p.id = i.product_id""")

oracle("scan_order_items", ["order_items", "product_variants", "product_colors", "products"], """
select concat('ord-', i.order_id) as order_id, concat('prod-', i.product_id) as product_id, i.variant_id, i.quantity, i.price, p.name as product_name,
  coalesce(c.image, c.image_2, p.image) as product_image, v.size, c.color_name as color
from order_items i left join product_variants v on v.id = i.variant_id
left join product_colors c on c.id = v.color_id left join products p on p.id = i.product_id""")

oracle("scan_wishlists", ["wishlist_events"], """
select concat('user-', user_id) as user_id, concat('prod-', product_id) as product_id from wishlist_events group by wishlist_events.user_id, wishlist_events.product_id
having arg_max(op, struct_pack(t := ts, e := event_id)) = 'add'""")
