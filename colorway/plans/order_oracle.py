"""Oracle texts: orders and payments."""

from __future__ import annotations

from colorway.plans.oracle import oracle
from colorway.sources.feeds import FLAWS, FORGED_KEY, PAYMENT_FEED_SQL, TEST_KEY


# --- orders and payments ---------------------------------------------------------


def _hmac(key: bytes, msg: str) -> str:
    padded = key + bytes(64 - len(key))  # the test keys are shorter than a block
    ipad, opad = (bytes(k ^ x for k in padded).hex() for x in (0x36, 0x5C))
    return f"to_base64(unhex(sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({msg}))))))"


_FEED = f"""
, feed as (
  select event_id, delivery, ts, body,
    case signing when 'good' then {_hmac(TEST_KEY, 'ts || body')}
                 when 'forged' then {_hmac(FORGED_KEY, 'ts || body')} else '' end as signature
  from ({PAYMENT_FEED_SQL}) f),
cls as (
  select *, case
      when signature is null or signature = '' or ts is null or ts = '' then '400'
      when signature <> {_hmac(TEST_KEY, "ts || coalesce(body, '')")} then '401'
      when jb is null or json_type(jb) = 'NULL' then '500'
      when not coalesce(json_type(jb, '$.type') = 'VARCHAR'
                        and json_extract_string(jb, '$.type') = 'PAYMENT_SUCCESS_WEBHOOK', false) then 'ignored'
      when oid is null then '500' else 'paid' end as status
  from (select *, case json_type(jb, '$.data.order.order_id')
          when 'VARCHAR' then case when json_extract_string(jb, '$.data.order.order_id') <> ''
                                   then json_extract_string(jb, '$.data.order.order_id') end
          when 'BIGINT' then cast(nullif(cast(json_extract(jb, '$.data.order.order_id') as bigint), 0) as varchar)
          when 'UBIGINT' then cast(nullif(cast(json_extract(jb, '$.data.order.order_id') as bigint), 0) as varchar)
          when 'DOUBLE' then case when cast(json_extract(jb, '$.data.order.order_id') as double)
                                       = floor(cast(json_extract(jb, '$.data.order.order_id') as double))
                                  then cast(nullif(cast(cast(json_extract(jb, '$.data.order.order_id') as double) as bigint), 0) as varchar) end
          end as oid
        from (select *, case when coalesce(json_valid(body), false) then body end as jb from feed) g) x)
"""

oracle("payment_feed", [], _FEED.replace("\n, feed", "\nfeed", 1) + " select event_id, delivery, ts, body, signature from feed")
oracle("payment_verified", [], _FEED.replace("\n, feed", "\nfeed", 1) + f"""
select event_id, delivery, coalesce(signature <> '' and ts <> ''
  and signature = {_hmac(TEST_KEY, "ts || coalesce(body, '')")}, false) as verified from feed""")
oracle("payment_fields", [], _FEED.replace("\n, feed", "\nfeed", 1) + """
select event_id, delivery, coalesce(json_type(jb) <> 'NULL', false) as parse_ok,
  json_extract_string(jb, '$.type') as type, json_extract_string(jb, '$.data.order.order_id') as order_id
from (select *, case when coalesce(json_valid(body), false) then body end as jb from feed) g""")
oracle("payment_status", [], _FEED.replace("\n, feed", "\nfeed", 1) + """
select event_id, delivery, status, case when status = 'paid' then oid end as paid_order_id from cls""")
oracle("payment_to_order", ["orders_t"], _FEED + """
select c.event_id, c.delivery, c.status, case when c.status = 'paid' then c.oid end as paid_order_id,
  (o.id is not null) as order_found
from cls c left join orders_t o on cast(o.id as varchar) = c.oid and c.status = 'paid'""")
oracle("orders_paid", ["orders_t"], _FEED + """
select o.id as order_id, case when cast(o.id as varchar) in (select oid from cls where status = 'paid') then 'paid' else o.status end as status
from orders_t o""")

_REQ = """
, cart as (select order_id, count(*) as n from order_items group by order_id),
req as (
  select r.*, substr(r.customer_id, 1, 6) = 'guest_' as is_guest, u.email as user_email, coalesce(c.n, 0) as n_items
  from order_requests r left join cart c on c.order_id = r.request_id
  left join users u on u.id = try_cast(r.customer_id as bigint)),
req2 as (
  select *,
    case when is_guest then concat('Guest ', request_id) end as guest_name,
    case when is_guest then concat('guest', request_id, '@example.com') else user_email end as email,
    case when is_guest and guest_city is not null then concat('98', lpad(cast(request_id % 100000000 as varchar), 8, '0')) end as phone,
    case when is_guest and guest_city = 'Pune' then 'MH' end as state,
    case when is_guest and guest_city = 'Pune' then '411001' end as postcode,
    case when coalesce(address_id, 0) = 0 and is_guest then sha256(concat('address:', cast(request_id as varchar))) end as new_address
  from req)
"""
_REQ_USES = ["order_requests", "order_items", "users"]

oracle("order_requests", _REQ_USES, _REQ + """
select cast(request_id as varchar) as request_id, amount, customer_id, n_items, is_guest as has_guest_address from req2""")

oracle("order_build", _REQ_USES, _REQ + """
select sha256(concat('order:', cast(request_id as varchar))) as order_id, cast(request_id as varchar) as request_id,
  case when length(customer_id) > 0 and substr(customer_id, 1, 6) <> 'guest_' then customer_id end as user_id,
  'pending' as status, amount as total_amount,
  coalesce(nullif(shipping_method, ''), 'standard') as shipping_method,
  cast(coalesce(shipping_fee, 0) as bigint) as shipping_fee, cast(null as varchar) as discount_id,
  cast(0 as bigint) as discount_amount,
  coalesce(case when coalesce(address_id, 0) <> 0 then cast(address_id as varchar) end, new_address) as address_id
from req2""")

oracle("order_build_addresses", _REQ_USES, _REQ + """
select new_address as id, cast(null as varchar) as user_id, 'Guest' as label, guest_line1 as address_line_1,
  guest_city as city, state, postcode as postal_code, 'IN' as country, cast(request_id as varchar) as request_id
from req2 where new_address is not null""")

oracle("order_item_rows", ["order_items", "order_requests"], """
select sha256(concat('order:', cast(order_id as varchar))) as order_id, cast(order_id as varchar) as request_id,
  cast(row_number() over (partition by order_id order by variant_id, quantity, price) - 1 as integer) as pos,
  variant_id, quantity, price
from order_items where order_id in (select request_id from order_requests)""")

oracle("order_defaults", _REQ_USES, _REQ + """
select sha256(concat('order:', cast(request_id as varchar))) as order_id, cast(request_id as varchar) as request_id,
  concat(cast(amount // 100 as varchar), '.', lpad(cast(amount % 100 as varchar), 2, '0')) as order_amount,
  customer_id, coalesce(nullif(phone, ''), '9999999999') as customer_phone,
  coalesce(nullif(email, ''), 'test@example.com') as customer_email
from req2""")

oracle("guest_owner", ["order_requests"], """
select request_id, case when length(customer_id) > 0 and substr(customer_id, 1, 6) <> 'guest_' then customer_id end as user_id
from order_requests""")

oracle("checkout_complete", _REQ_USES, _REQ + """
select cast(request_id as varchar) as request_id, case
  when is_guest and (guest_name is null or email is null or phone is null) then 'missing_contact'
  when is_guest and (guest_line1 is null or guest_city is null or state is null or postcode is null) then 'missing_address'
  when not is_guest and coalesce(address_id, 0) = 0 then 'missing_address_id'
  else 'ok' end as reason
from req2""")

_FLAW = "case " + " ".join(f"when request_id % {n} = 0 then '{name}'" for name, n in FLAWS.items()) + " else '' end"
_FLAWED = _REQ + f"""
, flawed as (select *, {_FLAW} as flaw from req2),
told as (select *, case flaw
    when 'refund' then 'Unknown action: refund' when 'no_action' then 'Unknown action: undefined'
    when 'amount_text' then 'Invalid amount: 12x' when 'amount_fraction' then 'Invalid amount: 125.5'
    when 'no_amount' then 'Invalid amount: undefined'
    when 'quantity' then case when n_items > 0 then 'Invalid quantity: two' end
    when 'price' then case when n_items > 0 then 'Invalid price: undefined' end
    when 'fee' then case when shipping_fee is not null then 'Invalid shipping_fee: free' end
    when 'cut' then 'Invalid request body' when 'list' then 'Invalid request body' when 'no_id' then 'Missing request_id' end as error
  from flawed)
"""
oracle("order_errors", _REQ_USES, _FLAWED + """
select case when flaw not in ('cut', 'list', 'no_id') then cast(request_id as varchar) end as request_id, error,
  case flaw when 'cut' then substr(concat('{"request_id":"', request_id, '","action":"create-order"'), 1, 24)
            when 'list' then concat('[', request_id, ']') when 'no_id' then '{"action":"create-order","amount":5}' end as body
from told where error is not null""")

oracle("order_build_flawed", _REQ_USES, _FLAWED + """
, sums as (select order_id, sum(quantity)::bigint as quantity, sum(quantity * price)::bigint as value from order_items group by order_id)
select cast(request_id as varchar) as request_id, amount as total_amount, cast(coalesce(shipping_fee, 0) as bigint) as shipping_fee,
  n_items, coalesce(sums.quantity, 0) as quantity, coalesce(sums.value, 0) as value
from told left join sums on sums.order_id = told.request_id where error is null""")

oracle("checkout_to_paid", ["order_requests"], """
select sha256(concat('order:', cast(request_id as varchar))) as order_id, cast(request_id as varchar) as request_id,
  case when request_id % 5 <> 0 and request_id % 7 <> 0 and request_id % 11 <> 0 then 'paid' else 'pending' end as status
from order_requests""")

oracle("scan_orders", _REQ_USES, _REQ + """
select sha256(concat('order:', cast(request_id as varchar))) as id,
  case when length(customer_id) > 0 and substr(customer_id, 1, 6) <> 'guest_' then customer_id end as user_id,
  case when substr(sha256(concat('order:', cast(request_id as varchar))), 1, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e')
       then 'paid' else 'pending' end as status,
  amount as total_amount, cast(coalesce(shipping_fee, 0) as bigint) as shipping_fee, cast(0 as bigint) as discount_amount,
  coalesce(case when coalesce(address_id, 0) <> 0 then cast(address_id as varchar) end, new_address) as address_id
from req2""")

oracle("scan_addresses", _REQ_USES, _REQ + """
select new_address as id, 'Guest' as label, guest_line1 as address_line_1, cast(null as varchar) as address_line_2,
  guest_city as city, state, postcode as postal_code, 'IN' as country
from req2 where new_address is not null""")
