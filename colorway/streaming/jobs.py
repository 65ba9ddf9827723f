"""Structured Streaming jobs.

Each job is ``readStream -> transform -> writeStream``. The state of X2 and X5
is Parquet partitioned by bucket (``sources.state``): a batch rewrites only
the buckets it touches. A batch may run twice (retry after a failure), so it
writes version ``batch_id + 1`` computed from the latest committed version
below it: a rerun overwrites its own output with the same rows. X4 only ever
adds rows: an order once paid stays paid, so the paid ids are a table of their
own, which Spark's file sink writes exactly once. Checkpoints live in the
given folder (on a cluster, under ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.operators import carts as CR
from colorway.operators import catalog as CT
from colorway.operators import orders as OR
from colorway.sources import io
from colorway.sources import state as ST
from colorway.streaming.rules import CATALOG_TABLES, affected_keys


def _start(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool = True):
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# --- X1: stale keys -------------------------------------------------------------------

def affected_keys_stream(spark: SparkSession, feed_path: str, out_path: str, checkpoint: str,
                         tables=None, available_now: bool = True):
    """Per batch, the distinct product ids the batch made stale, written to
    ``out_path/batch=<id>`` (a rerun of a batch overwrites its own folder).
    ``tables`` defaults to the two tables the client's feed listens to."""
    from colorway.streaming.rules import FEED_TABLES

    def process(batch: DataFrame, batch_id: int) -> None:
        ids = affected_keys(batch, tables or FEED_TABLES)
        ids.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")

    return _start(io.change_feed(spark, feed_path), process, checkpoint, available_now)


# --- X2: catalog refresh ------------------------------------------------------------

def catalog_for_products(tables, ids: DataFrame, source_buckets: int | None = None) -> DataFrame:
    """A4 restricted to the given product ids: every input of a product's
    catalog rows is cut down by semi joins before the aggregates run. Tables
    stored by the product's bucket (``state.store_by_product``, of
    ``source_buckets``) are read in the ids' buckets only: the distinct
    buckets are broadcast and prune the scans' partitions."""
    pid = ids.select(F.col("product_id").alias("id")).distinct()
    if source_buckets:
        # the comparison, always true, tells Catalyst that pruning by it pays
        held = F.broadcast(ST.touched(ids, "product_id", source_buckets).where(F.col(ST.BUCKET) >= 0))
        tables = {n: tables[n].join(held, ST.BUCKET, "left_semi").drop(ST.BUCKET) if n in ST.BY_PRODUCT else tables[n]
                  for n in (*ST.BY_PRODUCT, "categories")}
    colors = tables["product_colors"].join(pid.withColumnRenamed("id", "product_id"), "product_id", "left_semi")
    variants = tables["product_variants"].join(colors.select(F.col("id").alias("color_id")), "color_id", "left_semi")
    sub = {
        "products": tables["products"].join(pid, "id", "left_semi"),
        "product_colors": colors,
        "product_variants": variants,
        "reviews": tables["reviews"].join(pid.withColumnRenamed("id", "product_id"), "product_id", "left_semi"),
        "categories": tables["categories"],
    }
    return CT.color_catalog(sub)


def refresh_catalog_batch(tables_fn: Callable[[], object], base: str, tables=CATALOG_TABLES,
                          buckets: int | None = None, source_buckets: int | None = None):
    """foreachBatch body of X2: rebuild the rows of the products a change
    touched and swap them into the buckets (by product id) holding them; the
    other buckets are not rewritten. Without a state the batch builds it."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1
        prev = ST.previous(spark, base, version, buckets)
        t = tables_fn()
        if prev is None:  # no state yet: this version is a full build
            ST.create(CT.color_catalog(t), base, "product_id", buckets, version)
            return
        before, n = prev
        ids = affected_keys(batch, tables).persist()
        try:
            touched = ST.touched(ids, "product_id", n)
            rows = ST.read(spark, base, before, touched)
            fresh = catalog_for_products(t, ids, source_buckets).select(*rows.columns)
            new = rows.join(ids, "product_id", "left_anti").unionByName(fresh)
            ST.write(new, base, version, "product_id", n, touched, schema=rows.schema)
        finally:
            ids.unpersist()
    return process


def catalog_refresh(spark: SparkSession, feed_path: str, tables_fn, base: str, checkpoint: str,
                    tables=CATALOG_TABLES, available_now: bool = True, buckets: int | None = None,
                    source_buckets: int | None = None):
    """On changes to products, colours or variants, bring the catalog
    state up to date. Version 0 is a full build:
    ``state.create(color_catalog(tables), base, "product_id")``."""
    feed = io.change_feed(spark, feed_path)
    return _start(feed, refresh_catalog_batch(tables_fn, base, tables, buckets, source_buckets), checkpoint, available_now)


# --- X3 / X4: payments ----------------------------------------------------------------

def payment_status_stream(spark: SparkSession, feed_path: str, key: bytes) -> DataFrame:
    """Classification of each webhook call, as a stream."""
    return OR.classify_payments(io.payment_feed(spark, feed_path), key)


def paid_ids(classified: DataFrame) -> DataFrame:
    """The ids of paid orders, each once, from a stream of classified
    calls. Only paid calls carry an id; the others meet in one null row, so no
    filter sits on the classification (see ``orders.paid_order_ids``). The
    ids seen are kept in Spark's state store."""
    return classified.select(F.col("paid_order_id").alias("id")).dropDuplicates(["id"])


def orders_paid_stream(spark: SparkSession, feed_path: str, key: bytes, paid: str, checkpoint: str,
                       available_now: bool = True, max_files: int | None = None):
    """The paid ids of a feed, appended to the table ``paid``: a batch of n
    calls writes at most n rows, whatever the number of orders."""
    calls = OR.classify_payments(io.payment_feed(spark, feed_path, max_files=max_files), key)
    w = paid_ids(calls).writeStream.format("parquet").outputMode("append").option("path", paid).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def orders_with_payments(orders: DataFrame, paid: str) -> DataFrame:
    """The orders as of now: D6 with the ids that X4 wrote, joined when the
    orders are read. A feed without any batch has no paid order."""
    spark = orders.sparkSession
    fs, path = io._fs(spark, paid)
    ids = spark.read.schema("id string").parquet(paid) if fs.exists(path) else spark.createDataFrame([], "id string")
    return OR.orders_paid(orders, ids.where(F.col("id").isNotNull()))


# --- X5: cart state -------------------------------------------------------------------

#: Buckets of a cart state that starts empty, when its size is not known yet.
CART_BUCKETS = 64


def cart_state_batch(base: str, buckets: int | None = None, partitions: int | None = None,
                     attrs: list[str] | None = None):
    """foreachBatch body of X5: fold the batch's events onto the prior lines
    of the sessions it touches. State is bucketed by session (a clear
    empties a whole session, so it stays inside one bucket); only touched
    buckets are read and rewritten. ``attrs`` (e.g. name and price) are fixed
    by the add that creates a line. Events older than the state's latest
    event are applied in arrival order; each version's notes say how many
    there were (events, late_events, max_ts)."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1
        prev = ST.previous(spark, base, version, buckets)
        n = prev[1] if prev else buckets or CART_BUCKETS
        events = batch.persist()
        try:
            touched = ST.touched(events, "session_id", n)
            prior = ST.read(spark, base, prev[0], touched) if prev else None
            new = CR.cart_state(events, prior, partitions, attrs=attrs)
            latest = ST.notes(spark, base, prev[0]).get("max_ts") if prev else None
            ST.write(new, base, version, "session_id", n, touched, _notes(events, latest), prior.schema if prev else None)
        finally:
            events.unpersist()
    return process


def _notes(events: DataFrame, prior_max: str | None) -> dict:
    """One aggregate over the batch: its size, the events older than the
    state's latest event, and the new latest event time."""
    late = F.col("ts") < F.lit(prior_max).cast("timestamp_ntz") if prior_max is not None else F.lit(False)
    note = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(late).alias("late_events"),
                      F.max("ts").cast("string").alias("max_ts")).first().asDict()
    times = [t for t in (note["max_ts"], prior_max) if t is not None]
    return {**note, "max_ts": max(times) if times else None}


def cart_state_stream(spark: SparkSession, feed_path: str, base: str, checkpoint: str,
                      max_files: int | None = None, available_now: bool = True, buckets: int | None = None):
    """Cart lines kept up to date from a cart event stream."""
    return _start(io.cart_event_feed(spark, feed_path, max_files), cart_state_batch(base, buckets), checkpoint,
                  available_now)
