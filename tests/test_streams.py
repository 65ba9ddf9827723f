"""Stream jobs equal their batch forms, run with availableNow
triggers on files in fresh scratch folders."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from conftest import tables
from test_carts import SCHEMA as CART_SCHEMA, replay
from test_orders import sign

from colorway.operators import catalog as C
from colorway.operators import orders as OR
from colorway.sources import state as ST
from colorway.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def _write_json_files(folder, batches):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        with open(os.path.join(folder, f"part-{i:05d}.json"), "w") as fh:
            for r in rows:
                fh.write(json.dumps(r, default=str) + "\n")


def test_cart_stream_equals_batch(spark, scratch):
    rnd = random.Random(3)
    ops = ["add"] * 5 + ["change"] * 3 + ["remove", "clear"]
    events = [(i, T0 + dt.timedelta(seconds=i), rnd.randint(1, 6), rnd.randint(1, 4), rnd.choice(ops),
               rnd.randint(-9, 9)) for i in range(600)]
    want = replay(events)
    for files, per_trigger in [(6, 1), (12, 5)]:
        feed = os.path.join(scratch, f"feed-{files}")
        size = len(events) // files
        for j in range(files):
            chunk = events[j * size:(j + 1) * size] if j < files - 1 else events[j * size:]
            spark.createDataFrame(chunk, CART_SCHEMA).coalesce(1).write.parquet(os.path.join(feed, f"b{j:03d}"))
        # One folder per file batch: the stream reads the parquet files under feed/*.
        base = os.path.join(scratch, f"carts-{files}")
        q = jobs.cart_state_stream(spark, feed + "/*", base, os.path.join(scratch, f"ckpt-{files}"),
                                   max_files=per_trigger)
        q.awaitTermination()
        snap = ST.read(spark, base)
        got = {(r["session_id"], r["item_key"]): r["qty"] for r in snap.collect()}
        assert got == want
        assert len(ST.versions(spark, base)) > 1


def test_payment_stream_marks_orders(spark, scratch):
    key = b"k"
    ok = lambda oid: json.dumps({"type": "PAYMENT_SUCCESS_WEBHOOK", "data": {"order": {"order_id": str(oid)}}})
    calls = [
        {"event_id": 1, "delivery": 1, "ts": "1", "body": ok(2)},
        {"event_id": 2, "delivery": 1, "ts": "2", "body": ok(3)},
        {"event_id": 2, "delivery": 2, "ts": "2", "body": ok(3)},   # the same payment twice
        {"event_id": 3, "delivery": 1, "ts": "3", "body": ok(1)},   # forged below
        {"event_id": 4, "delivery": 1, "ts": "4", "body": "{bad"},
        {"event_id": 5, "delivery": 1, "ts": "5", "body": ok(99)},  # unknown order
    ]
    for c in calls:
        c["signature"] = sign(c["ts"], c["body"], key if c["event_id"] != 3 else b"forged")
    feed = os.path.join(scratch, "pay")
    _write_json_files(feed, [calls[:2], calls[2:4], calls[4:]])
    orders = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "delivered")], "id long, status string")
    paid, ckpt = os.path.join(scratch, "paid"), os.path.join(scratch, "ckpt")
    assert {r["status"] for r in jobs.orders_with_payments(orders, paid).collect()} == {"pending", "delivered"}  # no batch yet
    jobs.orders_paid_stream(spark, feed, key, paid, ckpt, max_files=1).awaitTermination()
    got = {r["id"]: r["status"] for r in jobs.orders_with_payments(orders, paid).collect()}
    batch = OR.orders_paid(orders, OR.paid_order_ids(OR.classify_payments(
        spark.read.schema("event_id bigint, delivery int, signature string, ts string, body string").json(feed), key)))
    assert got == {r["id"]: r["status"] for r in batch.collect()} == {1: "pending", 2: "paid", 3: "paid"}
    # three batches of two calls wrote each paid id once, and a null row for the others
    ids = [r["id"] for r in spark.read.parquet(paid).collect()]
    assert sorted(i for i in ids if i) == ["2", "3", "99"] and len(ids) <= 4
    # a later run goes on from the checkpoint: the same payment again writes nothing, a new one one row
    more = [{**calls[0]}, {"event_id": 9, "delivery": 1, "ts": "9", "body": ok(1), "signature": sign("9", ok(1), key)}]
    with open(os.path.join(feed, "part-00009.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in more))
    jobs.orders_paid_stream(spark, feed, key, paid, ckpt).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(paid).where("id IS NOT NULL").collect()) == ["1", "2", "3", "99"]
    assert {r["status"] for r in jobs.orders_with_payments(orders, paid).collect()} == {"paid"}


def _shop(spark, variant_color_2="1-a"):
    return tables(
        spark,
        products=[{"id": 1, "slug": "p-1", "name": "One", "is_active": True, "images": []},
                  {"id": 2, "slug": "p-2", "name": "Two", "is_active": True, "images": []},
                  {"id": 3, "slug": "p-3", "name": "Three", "is_active": True, "images": []}],
        product_colors=[{"id": c, "product_id": p, "color_name": c, "color_slug": c[-1], "color_hex": "#",
                         "sort_order": 0, "is_active": True, "images": []}
                        for c, p in [("1-a", 1), ("2-a", 2), ("3-a", 3)]],
        product_variants=[{"id": "v1", "product_id": 1, "color_id": "1-a", "size": "M", "inventory_count": 1},
                          {"id": "v2", "product_id": int(variant_color_2[0]), "color_id": variant_color_2,
                           "size": "L", "inventory_count": 0}],
        reviews=[{"id": "r", "product_id": 3, "rating": 5}])


def test_catalog_refresh_equals_full_rebuild(spark, scratch):
    before = _shop(spark)
    after = dict(_shop(spark, variant_color_2="2-a"))  # variant v2 moves to product 2
    after["products"] = after["products"].where(F.col("id") != 3)  # product 3 deleted
    base = os.path.join(scratch, "catalog")
    ST.create(C.color_catalog(before), base, "product_id", buckets=4)
    changes = [{"event_id": 1, "ts": str(T0), "table_name": "product_variants", "op": "UPDATE",
                "product_id": 2, "old_product_id": 1, "row_id": "v2"},
               {"event_id": 2, "ts": str(T0), "table_name": "products", "op": "DELETE", "product_id": 3},
               {"event_id": 3, "ts": str(T0), "table_name": "reviews", "op": "INSERT", "product_id": 1}]
    feed = os.path.join(scratch, "changes")
    _write_json_files(feed, [changes])
    jobs.catalog_refresh(spark, feed, lambda: after, base, os.path.join(scratch, "ckpt"),
                         buckets=4).awaitTermination()
    snap = ST.read(spark, base)
    full = C.color_catalog(after)
    key = lambda r: (r["color_id"], tuple(s["variant_id"] for s in r["sizes"]), r["has_stock"], r["review_count"])
    assert sorted(map(key, snap.collect())) == sorted(map(key, full.collect()))
    assert {r["color_id"] for r in snap.collect()} == {"1-a", "2-a"}


def test_payment_status_stream_matches_batch(spark, scratch):
    key = b"k"
    body = json.dumps({"type": "PAYMENT_SUCCESS_WEBHOOK", "data": {"order": {"order_id": "5"}}})
    calls = [{"event_id": i, "delivery": 1, "ts": str(i), "body": body if i % 3 else "null",
              "signature": sign(str(i), body if i % 3 else "null", key) if i % 4 else ""} for i in range(1, 13)]
    feed = os.path.join(scratch, "pay")
    _write_json_files(feed, [calls])
    out = os.path.join(scratch, "status")
    q = (jobs.payment_status_stream(spark, feed, key).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {r["event_id"]: r["status"] for r in spark.read.parquet(out).collect()}
    batch = OR.classify_payments(spark.read.json(feed), key)
    assert streamed == {r["event_id"]: r["status"] for r in batch.collect()}
    assert set(streamed.values()) == {"paid", "500", "400"}


def _cart_events(spark, *rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), *r) for i, r in enumerate(rows)], CART_SCHEMA)


def _lines(spark, base):
    return {(r["session_id"], r["item_key"]): r["qty"] for r in ST.read(spark, base).collect()}


def test_batches_rewrite_only_touched_buckets(spark, scratch):
    base = os.path.join(scratch, "state")
    lines = spark.range(0, 1000).select(F.col("id").alias("session_id"), F.lit(1).cast("long").alias("item_key"), F.lit(2).cast("long").alias("qty"))
    ST.create(lines, base, "session_id", buckets=16)
    events = _cart_events(spark, (3, 1, "add", 1), (5, 1, "remove", 1), (7, 1, "clear", 1))
    jobs.cart_state_batch(base)(events, 0)
    touched = {r[0] for r in ST.touched(events, "session_id", 16).collect()}
    written = {d for d in os.listdir(os.path.join(base, "rows")) if "v=1" in os.listdir(os.path.join(base, "rows", d))}
    assert written <= {f"bucket={b}" for b in touched} and len(touched) < 4
    state = _lines(spark, base)
    assert len(state) == 998 and state[3, 1] == 3 and (5, 1) not in state and (7, 1) not in state
    # A rerun of the same batch writes the same version and the same state.
    jobs.cart_state_batch(base)(events, 0)
    assert _lines(spark, base) == state and ST.versions(spark, base) == [0, 1]
    # the version before is still whole, and reading one bucket reads its newest partition only
    assert ST.read(spark, base, 0).count() == 1000
    plan = ST.read(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_an_emptied_bucket_stays_empty(spark, scratch):
    base = os.path.join(scratch, "state")
    step = jobs.cart_state_batch(base, buckets=4)
    step(_cart_events(spark, (1, 1, "add", 1), (2, 1, "add", 1)), 0)
    step(_cart_events(spark, (1, 1, "clear", 1), (2, 1, "clear", 1)), 1)
    assert _lines(spark, base) == {}
    step(_cart_events(spark, (2, 9, "add", 1)), 2)
    assert _lines(spark, base) == {(2, 9): 1}


def test_refresh_reads_only_the_buckets_of_changed_products(spark, scratch):
    """Every source scan that is stored by product carries a pruning filter."""
    base = os.path.join(scratch, "sources")
    ST.store_by_product(_shop(spark), base, 8)
    t = ST.tables_by_product(spark, base)
    ids = spark.createDataFrame([(2,)], "product_id long").persist()
    df = jobs.catalog_for_products(t, ids, 8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    by_product = [line for line in scans if "/categories" not in line]
    assert len(by_product) >= 4 and all("dynamicpruning" in line for line in by_product), plan
    assert [r["color_id"] for r in df.collect()] == ["2-a"]
    ids.unpersist()


def test_variants_lie_with_their_colours_product(spark, scratch):
    """A variant whose own product differs from its colour's is found by colour."""
    shop = dict(_shop(spark))
    shop["product_variants"] = shop["product_variants"].withColumn("product_id", F.lit(3).cast("long"))
    base = os.path.join(scratch, "sources")
    ST.store_by_product(shop, base, 8)
    ids = spark.createDataFrame([(1,), (2,)], "product_id long")
    key = lambda r: (r["color_id"], tuple(s["variant_id"] for s in r["sizes"]))
    got = sorted(map(key, jobs.catalog_for_products(ST.tables_by_product(spark, base), ids, 8).collect()))
    assert got == sorted(map(key, jobs.catalog_for_products(shop, ids).collect()))
    assert got[0] == ("1-a", ("v1", "v2"))


def test_affected_keys_stream(spark, scratch):
    changes = [{"event_id": i, "ts": str(T0), "table_name": t, "op": "UPDATE", "product_id": p,
                "old_product_id": o}
               for i, (t, p, o) in enumerate([("products", 1, None), ("product_variants", 2, 3),
                                              ("reviews", 4, None), ("product_colors", 5, None),
                                              ("products", 1, None)])]
    feed = os.path.join(scratch, "changes")
    _write_json_files(feed, [changes[:3], changes[3:]])
    out = os.path.join(scratch, "stale")
    jobs.affected_keys_stream(spark, feed, out, os.path.join(scratch, "ck")).awaitTermination()
    got = sorted(r["product_id"] for r in spark.read.parquet(out).collect())
    # products and variants only; a moved variant marks both products.
    assert sorted(set(got)) == [1, 2, 3]


def test_cart_stream_notes_late_events(spark, scratch):
    """An event older than the state's latest one is applied in arrival
    order and counted in the version's notes."""
    feed = os.path.join(scratch, "feed")
    b1 = [(1, T0 + dt.timedelta(seconds=10), 1, 1, "add", 1), (2, T0 + dt.timedelta(seconds=20), 1, 1, "add", 1)]
    b2 = [(3, T0 + dt.timedelta(seconds=5), 1, 1, "change", 5), (4, T0 + dt.timedelta(seconds=30), 1, 2, "add", 1)]
    for j, chunk in enumerate([b1, b2]):
        spark.createDataFrame(chunk, CART_SCHEMA).coalesce(1).write.parquet(os.path.join(feed, f"b{j}"))
    base = os.path.join(scratch, "carts")
    jobs.cart_state_stream(spark, feed + "/*", base, os.path.join(scratch, "ck"), max_files=1).awaitTermination()
    got = {(r["session_id"], r["item_key"]): r["qty"] for r in ST.read(spark, base).collect()}
    # Arrival order: add, add (2), then the late change (+5 -> 7). By event
    # time the change (t=5) would precede the adds and be ignored (2). The
    # late event is counted in the notes.
    assert got == {(1, 1): 7, (1, 2): 1}
    notes = ST.notes(spark, base, 2)
    assert notes["events"] == 2 and notes["late_events"] == 1


def test_superseded_partitions(spark, scratch):
    base = os.path.join(scratch, "state")
    step = jobs.cart_state_batch(base, buckets=4)
    for k in range(5):
        step(_cart_events(spark, (1, k, "add", 1)), k)  # one session, one bucket
    assert ST.versions(spark, base) == [1, 2, 3, 4, 5]
    old = sorted(r["v"] for r in ST.superseded(spark, base).collect())
    assert old == [1, 2, 3]  # the two latest versions, 4 and 5, stay readable
    assert ST.superseded(spark, base, keep=9) is None
    import shutil
    for r in ST.superseded(spark, base).collect():
        shutil.move(os.path.join(base, "rows", f"bucket={r['bucket']}", f"v={r['v']}"), os.path.join(scratch, f"gone-{r['v']}"))
    assert len(_lines(spark, base)) == 5 and ST.read(spark, base, 4).count() == 4
    step(_cart_events(spark, (1, 9, "add", 1)), 5)
    assert len(_lines(spark, base)) == 6


def test_catalog_refresh_batch_rerun_is_idempotent(spark, scratch):
    before = _shop(spark)
    after = dict(_shop(spark, variant_color_2="2-a"))
    base = os.path.join(scratch, "catalog")
    ST.create(C.color_catalog(before), base, "product_id", buckets=4)
    changes = spark.createDataFrame(
        [(1, T0, "product_variants", "UPDATE", 2, 1, "v2")],
        "event_id long, ts timestamp_ntz, table_name string, op string, product_id long, "
        "old_product_id long, row_id string")
    step = jobs.refresh_catalog_batch(lambda: after, base, buckets=4)
    key = lambda r: (r["color_id"], tuple(s["variant_id"] for s in r["sizes"]), r["has_stock"])
    step(changes, 0)
    first = sorted(map(key, ST.read(spark, base).collect()))
    step(changes, 0)  # the same batch again, e.g. after a failure
    again = sorted(map(key, ST.read(spark, base).collect()))
    assert first == again == sorted(map(key, C.color_catalog(after).collect()))
    assert ST.versions(spark, base) == [0, 1]


def test_catalog_refresh_without_initial_state(spark, scratch):
    t = _shop(spark)
    base = os.path.join(scratch, "catalog")
    changes = spark.createDataFrame([(1, T0, "products", "UPDATE", 1, None, None)],
                                    "event_id long, ts timestamp_ntz, table_name string, op string, "
                                    "product_id long, old_product_id long, row_id string")
    jobs.refresh_catalog_batch(lambda: t, base, buckets=4)(changes, 0)
    got = sorted(r["color_id"] for r in ST.read(spark, base).collect())
    assert got == sorted(r["color_id"] for r in C.color_catalog(t).collect())


def test_failed_attempt_is_not_seen(spark, scratch):
    """An attempt that dies midway leaves the state as it was, and its rerun
    writes the version."""
    base = os.path.join(scratch, "state")
    step = jobs.cart_state_batch(base, buckets=8)
    step(_cart_events(spark, *[(i, 1, "add", 1) for i in range(50)]), 0)
    before = _lines(spark, base)
    boom = F.udf(lambda s: 1 // 0 if s > 40 else s, "long")
    rows = ST.read(spark, base).withColumn("qty", boom("session_id"))
    only = spark.range(8).select(F.col("id").cast("int").alias("bucket"))
    try:
        ST.write(rows, base, 2, "session_id", 8, only)
        raise AssertionError("the write should have failed")
    except AssertionError:
        raise
    except Exception:  # noqa: BLE001 - the task's error, as Spark reports it
        pass
    # rows of version 2 without a commit, as when the driver dies between the two writes
    partial = ST.read(spark, base).withColumn("qty", F.lit(99).cast("long"))
    placed = partial.withColumn("bucket", ST.bucket_of(F.col("session_id"), 8)).withColumn("v", F.lit(2).cast("long"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(f"{base}/rows")
    assert ST.versions(spark, base) == [1] and _lines(spark, base) == before
    step(_cart_events(spark, (7, 1, "add", 1)), 1)
    assert _lines(spark, base) == {**before, (7, 1): 2}


def test_other_bucket_count_is_an_error(spark, scratch):
    import pytest
    base = os.path.join(scratch, "state")
    jobs.cart_state_batch(base, buckets=16)(_cart_events(spark, (1, 1, "add", 1)), 0)
    with pytest.raises(ValueError, match="16 buckets, not 8"):
        jobs.cart_state_batch(base, buckets=8)(_cart_events(spark, (1, 1, "add", 1)), 1)


def test_batches_without_initial_state(spark, scratch):
    """Two batches from nothing: the catalog is built, then brought up to date;
    a cart starts empty."""
    t = _shop(spark)
    base = os.path.join(scratch, "catalog")
    changes = spark.createDataFrame([(1, T0, "products", "UPDATE", 1, None, None)],
                                    "event_id long, ts timestamp_ntz, table_name string, op string, "
                                    "product_id long, old_product_id long, row_id string")
    step = jobs.refresh_catalog_batch(lambda: t, base)
    step(changes, 0)
    step(changes, 1)
    assert ST.versions(spark, base) == [1, 2]
    assert ST.read(spark, base).count() == C.color_catalog(t).count()


def test_cart_job_after_init(spark, scratch):
    base = os.path.join(scratch, "carts")
    lines = spark.createDataFrame([(1, 1, 3), (2, 1, 5)], "session_id long, item_key long, qty long")
    ST.create(lines, base, "session_id")
    events = spark.createDataFrame([(1, T0, 1, 1, "add", 1)], CART_SCHEMA)
    jobs.cart_state_batch(base)(events, 0)
    got = {(r["session_id"], r["item_key"]): r["qty"] for r in ST.read(spark, base).collect()}
    assert got == {(1, 1): 4, (2, 1): 5} and ST.notes(spark, base, 1)["events"] == 1


def test_a_state_has_a_bucket_for_so_many_rows():
    assert [ST.bucket_count(n) for n in (0, 5, 3_000_000, 10 ** 12)] == [16, 16, 30, 4096]


def test_a_state_of_given_buckets_is_written_without_keeping_its_rows(spark, scratch, monkeypatch):
    """Rows are kept only where they have to be counted first."""
    base = os.path.join(scratch, "given")
    rows = spark.createDataFrame([(k, k * 2) for k in range(50)], "product_id long, n long")
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: 1 / 0)
    ST.create(rows, base, "product_id", 32)
    assert ST.previous(spark, base, 1) == (0, 32)
    assert sorted(map(tuple, ST.read(spark, base).collect())) == [(k, k * 2) for k in range(50)]


def test_refresh_buckets_follow_the_size_of_the_tables(spark, monkeypatch):
    """A batch reads and rewrites whole buckets, whose size does not grow."""
    from colorway.plans import state_queries as SQ
    from colorway.sources import io
    from colorway.sources.fixtures import load_tables
    t = load_tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(io, "source_bytes", lambda df: 16 * SQ.REFRESH_SOURCE_BYTES)
    made = []
    monkeypatch.setattr(ST, "create", lambda df, base, key, buckets=None: made.append(buckets))
    monkeypatch.setattr(ST, "store_by_product", lambda t, base, buckets: made.append(buckets))
    monkeypatch.setattr(jobs, "refresh_catalog_batch", lambda *a, source_buckets: made.append(source_buckets) or (lambda batch, k: None))
    monkeypatch.setattr(ST, "read", lambda spark, base: made)
    monkeypatch.setattr(SQ, "flat_catalog", lambda df: df)
    assert SQ.q_catalog_refresh(t) == [64, 64, 64]
