import base64
import hashlib
import hmac

from pyspark.sql import functions as F

from colorway.functions import payments as PAY
from colorway.operators import orders as OR
from colorway.sources.schemas import ORDER_REQUEST_JSON

KEY = b"secret-key"
UUID_BODY = '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":"0b9c7e1a-5d2f-4c3b-9a8e-7f6d5c4b3a21"}}}'
OBJECT_BODY = '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":{"a":1}}}}'


def sign(ts, body, key=KEY):
    return base64.b64encode(hmac.new(key, (ts + body).encode(), hashlib.sha256).digest()).decode()


def test_hmac_matches_python(spark):
    msgs = ["", "a", "ünïcødé ✓", "x" * 200]
    long_key = b"k" * 100
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    for key in (KEY, long_key):
        got = [r[0] for r in df.select(PAY.hmac_sha256_base64(key, F.col("m"))).collect()]
        want = [base64.b64encode(hmac.new(key, m.encode(), hashlib.sha256).digest()).decode() for m in msgs]
        assert got == want


def test_payment_classification(spark):
    ok = '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":"42"}}}'
    cases = [
        ("t1", ok, sign("t1", ok), ("paid", "42")),
        ("t1", ok, None, ("400", None)),
        ("t1", ok, "", ("400", None)),
        (None, ok, sign("", ok), ("400", None)),
        ("t1", ok, sign("t1", ok, b"forged"), ("401", None)),
        ("t1", "{bad", sign("t1", "{bad"), ("500", None)),
        ("t1", "null", sign("t1", "null"), ("500", None)),
        ("t1", "5", sign("t1", "5"), ("ignored", None)),
        ("t1", '{"type":"PAYMENT_FAILED_WEBHOOK"}', sign("t1", '{"type":"PAYMENT_FAILED_WEBHOOK"}'), ("ignored", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK"}', sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK"}'), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":""}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":""}}}'), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":0}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":0}}}'), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7}}}'), ("paid", "7")),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7.0}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7.0}}}'), ("paid", "7")),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":1e2}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":1e2}}}'), ("paid", "100")),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7.5}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":7.5}}}'), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":0.0}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":0.0}}}'), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":"abc"}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":"abc"}}}'), ("paid", "abc")),
        ("t1", UUID_BODY, sign("t1", UUID_BODY), ("paid", "0b9c7e1a-5d2f-4c3b-9a8e-7f6d5c4b3a21")),
        ("t1", OBJECT_BODY, sign("t1", OBJECT_BODY), ("500", None)),
        ("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":true}}}',
         sign("t1", '{"type":"PAYMENT_SUCCESS_WEBHOOK","data":{"order":{"order_id":true}}}'), ("500", None)),
    ]
    feed = spark.createDataFrame([(i, c[2], c[0], c[1]) for i, c in enumerate(cases)],
                                 "i int, signature string, ts string, body string")
    got = {r["i"]: (r["status"], r["paid_order_id"]) for r in OR.classify_payments(feed, KEY).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_orders_paid_idempotent(spark):
    orders = spark.createDataFrame([(1, "pending"), (2, "shipped"), (3, "pending")], "id long, status string")
    paid = spark.createDataFrame([(2,), (2,), (99,)], "id long")
    once = OR.orders_paid(orders, paid)
    twice = OR.orders_paid(once, paid)
    want = {1: "pending", 2: "paid", 3: "pending"}
    assert {r["id"]: r["status"] for r in once.collect()} == want
    assert {r["id"]: r["status"] for r in twice.collect()} == want


def test_build_orders_defaults(spark):
    rows = [
        {"request_id": "r1", "action": "create-order", "amount": 12345, "customerId": "guest_1",
         "orderMeta": {"address_id": None, "guest_address": {"line1": "L", "city": "C", "state": "S",
                                                             "postalCode": "P"},
                       "shipping_method": "", "shipping_fee": 0, "discount_id": 0, "discount_amount": None},
         "cartItems": [{"variant_id": "v1", "qty": 2, "price": 100}, {"variant_id": "v2", "qty": 1, "price": 5}]},
        {"request_id": "r2", "action": "create-order", "amount": 5, "customerId": "u-9", "customerPhone": "",
         "orderMeta": {"address_id": 77, "shipping_method": "express", "shipping_fee": 20000}, "cartItems": []},
        {"request_id": "r3", "action": "other", "amount": 1, "customerId": "", "cartItems": None},
    ]
    import json
    rdd_rows = [json.dumps(r) for r in rows]
    req = spark.read.schema(ORDER_REQUEST_JSON).json(spark.sparkContext.parallelize(rdd_rows))
    out = OR.build_orders(req)
    orders = {r["request_id"]: r for r in out["orders"].collect()}
    assert set(orders) == {"r1", "r2"}
    g, m = orders["r1"], orders["r2"]
    assert g["user_id"] is None and m["user_id"] == "u-9"
    assert g["shipping_method"] == "standard" and g["shipping_fee"] == 0 and g["discount_id"] is None
    assert g["status"] == "pending" and g["discount_amount"] == 0
    assert m["address_id"] == "77" and m["shipping_method"] == "express"
    addrs = out["addresses"].collect()
    assert len(addrs) == 1 and addrs[0]["id"] == g["address_id"] and addrs[0]["country"] == "IN"
    assert addrs[0]["label"] == "Guest" and addrs[0]["user_id"] is None
    items = sorted((r["request_id"], r["variant_id"], r["quantity"]) for r in out["order_items"].collect())
    assert items == [("r1", "v1", 2), ("r1", "v2", 1)]
    gw = {r["request_id"]: r for r in out["gateway"].collect()}
    assert gw["r1"]["order_amount"] == "123.45"
    assert gw["r2"]["customer_phone"] == "9999999999" and gw["r2"]["customer_email"] == "test@example.com"
    # Reruns give the same ids.
    again = {r["request_id"]: r["order_id"] for r in OR.build_orders(req)["orders"].collect()}
    assert again == {k: v["order_id"] for k, v in orders.items()}


def test_checkout_complete(spark):
    df = spark.createDataFrame(
        [(True, "n", "e", "p", "l", "c", "s", "z", None), (True, "n", "", "p", "l", "c", "s", "z", None),
         (True, "n", "e", "p", "l", None, "s", "z", None), (False, None, None, None, None, None, None, None, 0),
         (False, None, None, None, None, None, None, None, 5)],
        "g boolean, n string, e string, p string, l string, c string, s string, z string, a long")
    r = OR.checkout_complete(F.col("g"), [F.col("n"), F.col("e"), F.col("p")],
                             [F.col("l"), F.col("c"), F.col("s"), F.col("z")], F.col("a"))
    assert [x[0] for x in df.select(r).collect()] == [
        "ok", "missing_contact", "missing_address", "missing_address_id", "ok"]


def test_order_requests_source(spark, scratch):
    import json
    import os
    from colorway.sources import io
    rows = [{"request_id": "a", "action": "create-order", "amount": 500, "customerId": "guest_9",
             "orderMeta": {"guest_address": {"line1": "L", "city": "C"}},
             "cartItems": [{"variant_id": "v", "qty": 3, "price": 100}]}]
    path = os.path.join(scratch, "req")
    os.makedirs(path)
    with open(os.path.join(path, "r.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    out = OR.build_orders(io.order_requests(spark, path))
    o = out["orders"].collect()[0]
    assert o["user_id"] is None and o["address_id"] == out["addresses"].collect()[0]["id"]
    assert [(r["variant_id"], r["quantity"]) for r in out["order_items"].collect()] == [("v", 3)]


def test_text_ids_and_unknown_actions(spark):
    """Text address and discount ids are kept; other actions give errors."""
    import json
    import os
    import tempfile

    from colorway.sources import io
    folder = tempfile.mkdtemp(prefix="colorway-test-", dir="/tmp")
    rows = [{"request_id": "a", "action": "create-order", "amount": 100, "customerId": "u",
             "orderMeta": {"address_id": "6f1c-uuid", "discount_id": "d-uuid"}, "cartItems": []},
            {"request_id": "b", "action": "create-order", "amount": 100, "customerId": "u", "orderMeta": {"address_id": 0}},
            {"request_id": "c", "action": "refund"}, {"request_id": "d"}]
    with open(os.path.join(folder, "r.json"), "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    out = OR.build_orders(io.order_requests(spark, folder))
    assert {r["request_id"]: (r["address_id"], r["discount_id"]) for r in out["orders"].collect()} == \
        {"a": ("6f1c-uuid", "d-uuid"), "b": (None, None)}
    assert {r["request_id"]: r["error"] for r in out["errors"].collect()} == \
        {"c": "Unknown action: refund", "d": "Unknown action: undefined"}


def test_member_with_text_address_can_pay(spark):
    df = spark.createDataFrame([("6f1c-uuid",), ("",), ("0",), (None,)], "a string")
    got = [r[0] for r in df.select(OR.checkout_complete(F.lit(False), [], [], F.col("a"))).collect()]
    assert got == [OR.COMPLETE] + [OR.MISSING_ADDRESS_ID] * 3


def _lines(spark, lines):
    import os
    import tempfile

    from colorway.sources import io
    folder = tempfile.mkdtemp(prefix="colorway-test-", dir="/tmp")
    with open(os.path.join(folder, "r.json"), "w") as f:
        f.write("\n".join(lines))
    return io.order_requests(spark, folder)


def test_whole_numbers(spark):
    texts = ["12", " 7 ", "-3", "125.0", "1e2", "1.5e1", "125.5", "12x", "", "true", "NaN", "1e40", "9223372036854775807",
             "9223372036854775808", "0x1f", "1_000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from colorway.functions.money import whole_number
    assert [r[0] for r in df.select(whole_number(F.col("t"))).collect()] == [
        12, 7, -3, 125, 100, 15, None, None, None, None, None, None, 2 ** 63 - 1, None, None, None, None]
    assert df.select(whole_number(F.lit(5).cast("long"))).first()[0] == 5


def test_bad_requests_become_error_rows(spark):
    """Every request gives an order or an error row, and no NULL money gets in."""
    good = '{"request_id":"%s","action":"create-order","amount":%s,"cartItems":%s}'
    item = '[{"variant_id":"v","qty":%s,"price":%s}]'
    cases = {
        "ok": (good % ("ok", "100", item % ("2", "50")), None),
        "text": (good % ("text", '"100"', item % ('"2"', '"50"')), None),
        "none": (good % ("none", "100", "null"), None),
        "12x": (good % ("12x", '"12x"', "[]"), "Invalid amount: 12x"),
        "half": (good % ("half", "125.5", "[]"), "Invalid amount: 125.5"),
        "null": (good % ("null", "null", "[]"), "Invalid amount: undefined"),
        "true": (good % ("true", "true", "[]"), "Invalid amount: true"),
        "qty": (good % ("qty", "1", item % ('"two"', "5")), "Invalid quantity: two"),
        "price": (good % ("price", "1", item % ("2", "null")), "Invalid price: undefined"),
        "item": (good % ("item", "1", "[null]"), "Invalid quantity: undefined"),
        "both": (good % ("both", "1", '[{"variant_id":"v","qty":1,"price":1},{"variant_id":"w","qty":1,"price":"x"}]'), "Invalid price: x"),
        "fee": ('{"request_id":"fee","action":"create-order","amount":1,"orderMeta":{"shipping_fee":"free"}}', "Invalid shipping_fee: free"),
        "off": ('{"request_id":"off","action":"create-order","amount":1,"orderMeta":{"discount_amount":1.5}}', "Invalid discount_amount: 1.5"),
        "empty": ('{"request_id":"empty","action":"create-order","amount":1,"orderMeta":{"discount_amount":"","shipping_fee":0}}', None),
        "act": ('{"request_id":"act","action":"pay","amount":"x"}', "Unknown action: pay"),
        "shape": ('{"request_id":"shape","action":"create-order","amount":1,"cartItems":"v"}', "Invalid request body"),
    }
    loose = ['{"request_id":"cut","action":"create-or', "[" + cases["ok"][0] + "]", "5", "null", "nonsense", '{"action":"create-order","amount":1}',
             '{"request_id":"","action":"create-order","amount":1}']
    out = OR.build_orders(_lines(spark, [c[0] for c in cases.values()] + loose + ["", "  "]))
    errors = out["errors"].collect()
    assert {r["request_id"]: r["error"] for r in errors if r["request_id"]} == {k: e for k, (_, e) in cases.items() if e}
    assert sorted((r["body"], r["error"]) for r in errors if not r["request_id"]) == sorted(
        [(b, "Invalid request body") for b in loose[:5]] + [(b, "Missing request_id") for b in loose[5:]])
    orders = {r["request_id"]: r for r in out["orders"].collect()}
    assert set(orders) == {k for k, (_, e) in cases.items() if not e}
    assert all(r["total_amount"] is not None and r["shipping_fee"] == 0 and r["discount_amount"] == 0 for r in orders.values())
    assert sorted((r["request_id"], r["quantity"], r["price"]) for r in out["order_items"].collect()) == [("ok", 2, 50), ("text", 2, 50)]
    assert {r["request_id"] for r in out["gateway"].collect()} == set(orders)


def test_bad_requests_in_a_stream(spark, scratch):
    """The same source as a stream: orders and errors of each batch."""
    import os

    from colorway.sources import io
    folder, seen = os.path.join(scratch, "in"), []
    os.makedirs(folder)
    for k, line in enumerate(['{"request_id":"a","action":"create-order","amount":5}', '{"request_id":"b","action":"create-order","amount":"x"}']):
        with open(os.path.join(folder, f"{k}.json"), "w") as f:
            f.write(line + "\n")

    def process(batch, _):
        made = OR.build_orders(batch)
        seen.extend(("order", r["request_id"]) for r in made["orders"].collect())
        seen.extend(("error", r["request_id"]) for r in made["errors"].collect())

    q = io.order_requests(spark, folder, streaming=True).writeStream.foreachBatch(process) \
        .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [("error", "b"), ("order", "a")]


def test_a_request_line_is_parsed_once(spark, scratch):
    """S7 -> D5: filters on a request's fields do not parse its line again."""
    from colorway.sources import io
    path = f"{scratch}/requests"
    spark.createDataFrame([('{"request_id":"1","action":"create-order","amount":"5","cartItems":[{"variant_id":"a","qty":1,"price":2}]}',),
                           ("[1]",), (" ",), ('{"request_id":"2","act',)], "value string").write.text(path)
    made = OR.build_orders(io.order_requests(spark, path))
    for name, rows in (("orders", 1), ("order_items", 1), ("errors", 2)):
        assert made[name]._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1, name
        assert made[name].count() == rows


def test_whole_number_takes_what_an_integer_column_takes(spark):
    from colorway.functions import money as M
    cases = {"7": 7, " +12 ": 12, "-3": -3, "9" * 18: int("9" * 18), str(2 ** 63 - 1): 2 ** 63 - 1, str(2 ** 63): None, "007": 7, "12.0": 12,
             "1e2": 100, "125.5": None, "12x": None, "": None, "+": None, "true": None}
    got = spark.createDataFrame([(c,) for c in cases], "v string").select("v", M.whole_number(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in got} == cases


def test_requests_without_a_user_spread_over_the_tasks(spark):
    """Guests and requests without a customer meet no user in a task of their own."""
    from colorway.sources import feeds as FD
    from conftest import tables
    t = tables(spark, users=[{"id": 5, "email": "u5@x"}, {"id": None, "email": "none@x"}],
               order_requests=[{"request_id": k, "customer_id": c, "amount": 1} for k, c in
                               enumerate(["5", "05", "guest_3", "", None, "99999999999999999999"])])
    df = FD.checkout_requests(t)
    assert {r["request_id"]: r["customerEmail"] for r in df.collect()} == {
        "0": "u5@x", "1": "u5@x", "2": "guest2@example.com", "3": None, "4": None, "5": None}
    assert "coalesce(concat(=" in df._jdf.queryExecution().optimizedPlan().toString()
