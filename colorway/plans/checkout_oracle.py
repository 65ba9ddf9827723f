"""Oracle texts: checkout pricing."""

from __future__ import annotations

from colorway.plans.oracle import oracle


# --- pricing -------------------------------------------------------------------

oracle("cart_totals", ["order_items"], """
select order_id, cast(sum(quantity) as bigint) as item_count, cast(sum(quantity * price) as bigint) as subtotal,
  count(*) as lines from order_items group by order_id""")

oracle("shipping_config", ["shipping_config", "checkouts", "order_items"], """
, d as (select 500000 as free_above, 10000 as flat_rate, 20000 as express_rate),
cfg as (select * from (select * from shipping_config limit 1) union all
        select * from d where not exists (select 1 from shipping_config)),
tot as (select order_id, sum(quantity * price) as subtotal from order_items group by order_id)
select c.session_id, g.free_above, g.flat_rate, g.express_rate, t.subtotal >= g.free_above as free_shipping
from checkouts c join tot t on t.order_id = c.session_id, cfg g""")

oracle("shipping_config_default", ["checkouts", "order_items"], """
, tot as (select order_id, sum(quantity * price) as subtotal from order_items group by order_id)
select c.session_id, 500000 as free_above, 10000 as flat_rate, 20000 as express_rate, t.subtotal >= 500000 as free_shipping
from checkouts c join tot t on t.order_id = c.session_id""")

oracle("code_lookup", ["checkouts", "discount_codes"], """
, m as (select code, count(*) as n, min(id) as id from discount_codes where is_active group by code)
select c.session_id, c.typed_code, case when m.n = 1 then m.id end as code_id,
  case when m.n is null then 'none' when m.n = 1 then 'ok' else 'many' end as lookup
from checkouts c left join m on m.code = upper(c.typed_code)""")

oracle("lookup_one", ["products", "order_items"], """
, one as (select slug, count(*) as n, min(id) as id from products where is_active group by slug),
asked as (select distinct concat('p-', product_id) as slug from order_items)
select a.slug, case when o.n is null then 'none' when o.n = 1 then 'ok' else 'many' end as lookup,
  case when o.n = 1 then o.id end as product_id
from asked a left join one o on o.slug = a.slug""")

_PRICED = """
, tot as (select order_id as session_id, cast(sum(quantity) as bigint) as item_count,
                 cast(sum(quantity * price) as bigint) as subtotal, count(*) as lines
          from order_items group by order_id),
cfg as (select * from (select * from shipping_config limit 1) union all
        select 500000, 10000, 20000 where not exists (select 1 from shipping_config)),
one as (select code from discount_codes where is_active group by code having count(*) = 1),
dc as (select d.* from discount_codes d join one using (code) where d.is_active),
base as (
  select c.session_id, c.typed_code, c.now_ts, c.shipping_method, t.item_count, t.subtotal, t.lines, d.*
  from checkouts c join tot t on t.session_id = c.session_id
  left join dc d on d.code = upper(c.typed_code)),
chk as (
  select *, case
    when typed_code is null or trim(typed_code) = '' then 'no_code'
    when code is null then 'no_match'
    when starts_at is not null and starts_at > now_ts then 'not_started'
    when expires_at is not null and expires_at < now_ts then 'expired'
    when coalesce(max_uses, 0) <> 0 and coalesce(used_count, 0) >= max_uses then 'used_up'
    when coalesce(min_order_value, 0) <> 0 and subtotal < min_order_value then 'below_minimum'
    else 'ok' end as discount_status
  from base),
amt as (
  select *, case when discount_status <> 'ok' then 0
    else least(subtotal, case discount_type when 'fixed' then coalesce(discount_value, 0)
                              when 'percentage' then cast(floor(subtotal * (coalesce(discount_value, 0) / 100)) as bigint)
                              else 0 end) end as discount_amount
  from chk),
fee as (
  select a.*, case a.shipping_method
      when 'standard' then case when a.subtotal >= coalesce(g.free_above, 0) then 0 else coalesce(g.flat_rate, 0) end
      when 'express' then coalesce(g.express_rate, 0) else 0 end as shipping_fee
  from amt a, cfg g),
fin as (select *, greatest(0, subtotal - discount_amount + shipping_fee) as total from fee)
"""

INDIAN = ("concat('₹', case when {n} < 0 then '-' else '' end, "
          "case when length(cast(abs({n}) // 100 as varchar)) <= 3 then cast(abs({n}) // 100 as varchar) else "
          "concat(reverse(array_to_string(regexp_extract_all(reverse(left(cast(abs({n}) // 100 as varchar), "
          "length(cast(abs({n}) // 100 as varchar)) - 3)), '.{{1,2}}'), ',')), ',', "
          "right(cast(abs({n}) // 100 as varchar), 3)) end, '.', lpad(cast(abs({n}) % 100 as varchar), 2, '0'))")

PLAIN = ("concat(case when {n} < 0 then '-' else '' end, cast(abs({n}) // 100 as varchar), '.', "
         "lpad(cast(abs({n}) % 100 as varchar), 2, '0'))")

_PRICE_USES = ["checkouts", "order_items", "discount_codes", "shipping_config"]

oracle("discount_check", _PRICE_USES, _PRICED + "select session_id, discount_status from fin")
oracle("discount_amount", _PRICE_USES, _PRICED + "select session_id, subtotal, cast(discount_amount as bigint) as discount_amount from fin")
oracle("shipping_fee", _PRICE_USES, _PRICED + "select session_id, shipping_method, cast(shipping_fee as bigint) as shipping_fee from fin")
oracle("order_total", _PRICE_USES, _PRICED + "select session_id, cast(total as bigint) as total from fin")
_PRICING = f"""
select session_id, item_count, subtotal, lines, discount_status,
  case when discount_status = 'ok' then id end as discount_id,
  cast(discount_amount as bigint) as discount_amount, shipping_method, cast(shipping_fee as bigint) as shipping_fee,
  cast(total as bigint) as total, {INDIAN.format(n='total')} as total_label,
  {PLAIN.format(n='total')} as gateway_amount
from fin"""
oracle("checkout_pricing", _PRICE_USES, _PRICED + _PRICING)

# The cart replayed event by event; a line keeps the name and price of the add
# that made it.
CART_LINES = """
, k as (select distinct session_id, item_key from cart_events where op <> 'clear'),
ev as (
  select session_id, item_key, ts, event_id, op, delta from cart_events where op <> 'clear'
  union all
  select k.session_id, k.item_key, e.ts, e.event_id, e.op, e.delta
  from k join cart_events e on e.session_id = k.session_id where e.op = 'clear'),
seq as (select *, row_number() over (partition by session_id, item_key order by ts, event_id) as rn from ev),
rec as (
  select session_id, item_key, cast(0 as bigint) as rn, cast(0 as bigint) as q, cast(null as bigint) as price from k
  union all
  select r.session_id, r.item_key, s.rn,
    case s.op when 'add' then case when r.q = 0 then 1 else least(20, r.q + 1) end
              when 'change' then case when r.q = 0 then 0 else greatest(1, least(20, r.q + coalesce(s.delta, 0))) end
              else 0 end,
    case when s.op = 'add' and r.q = 0 then (s.item_key + 1) * 10000 + (s.event_id // 10) * 100
         when s.op in ('add', 'change') then r.price end
  from rec r join seq s on s.session_id = r.session_id and s.item_key = r.item_key and s.rn = r.rn + 1),
lines as (
  select session_id, item_key, cast(arg_max(q, rn) as bigint) as qty, concat('Item ', item_key) as name,
    arg_max(struct_pack(p := price), rn).p as price
  from rec group by session_id, item_key having arg_max(q, rn) > 0)"""

oracle("cart_lines", ["cart_events"], CART_LINES + " select session_id, item_key, qty, name, price from lines", recursive=True)
oracle("cart_checkout", ["checkouts", "discount_codes", "shipping_config", "cart_events"], CART_LINES + """,
order_items as (select session_id as order_id, qty as quantity, price from lines)""" + _PRICED + _PRICING, recursive=True)
oracle("scan_discount_codes", ["checkouts", "order_items", "discount_codes", "shipping_config"], """
, codes as (select * replace (concat('code-', id) as id, cast(discount_value as double)
                              + case when discount_type = 'percentage' then 0.5 else 0 end as discount_value) from discount_codes)
""" + _PRICED.replace("from discount_codes where", "from codes where").replace("from discount_codes d", "from codes d")
.replace("case discount_type when 'fixed' then coalesce(discount_value, 0)", "case discount_type when 'fixed' then cast(coalesce(discount_value, 0) as bigint)")
+ """ select session_id, discount_status, case when discount_status = 'ok' then id end as discount_id,
  cast(discount_amount as bigint) as discount_amount from fin""")
oracle("discount_fractions", ["orders_t"], """
select id as order_id, least(total_amount, cast(floor(cast(total_amount as double) * ((id % 40 + 0.5::double) / 100.0)) as bigint))
  as discount_amount from orders_t""")

oracle("price_labels", ["orders_t"], f"""
select id as order_id, total_amount, {INDIAN.format(n='total_amount')} as label from orders_t""")

oracle("gateway_amount", ["order_requests"], f"""
select request_id, {PLAIN.format(n='amount')} as order_amount from order_requests""")

oracle("line_totals", ["order_items"], f"""
select order_id, variant_id, quantity * price as line_total, {INDIAN.format(n='quantity * price')} as label
from order_items""")

oracle("cart_keys", ["order_items", "products", "product_variants"], """
select i.order_id, i.variant_id,
  coalesce(nullif(i.variant_id, ''), concat_ws('-', p.slug, v.size)) as cart_key
from order_items i left join products p on p.id = i.product_id left join product_variants v on v.id = i.variant_id""")

oracle("scan_cart_items", ["cart_events"], CART_LINES + """
select cast(session_id as varchar) as session_id, cast(item_key as varchar) as variant_id, qty as quantity, price as price_at_add
from lines""", recursive=True)
