"""State of stream jobs (X2, X5) as plain Parquet partitioned by bucket.

Rows lie in ``<base>/rows/bucket=B/v=N``; B is ``pmod(hash(key as text), n)``
and N the version that wrote the bucket last. A batch writes the buckets it
touched, whole, with Spark's dynamic partition overwrite, and then the S3
snapshot ``<base>/commits/v=N``: a row for each of them. That snapshot's
``_SUCCESS`` is the commit; a batch that runs again overwrites the same
partitions with the same rows. The state is the rows whose (bucket, v) is the
newest committed one of its bucket, a join that prunes the scan to those
partitions. A bucket that a batch emptied has a commit row and no files.

The number of buckets follows the rows when a state is made (ROWS_PER_BUCKET
each, at most MOST_BUCKETS) and stays. A batch whose keys touch every bucket
rewrites the state; batches should be small against the number of buckets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colorway.sources import io

BUCKET, VERSION = "bucket", "v"
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
_ALL = -1  # the commit row that carries the version's notes


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key.cast("string")), F.lit(buckets))


def bucket_count(rows: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // ROWS_PER_BUCKET))


def touched(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The distinct buckets of a batch's keys: at most MOST_BUCKETS rows."""
    return keys.where(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets).alias(BUCKET)).distinct()


def _commits(base: str) -> str:
    return f"{base.rstrip('/')}/commits"


def versions(spark: SparkSession, base: str) -> list[int]:
    return io.committed_versions(spark, _commits(base))


def notes(spark: SparkSession, base: str, version: int) -> dict:
    """What a version's commit says of itself: one small row."""
    row = io.read_snapshot(spark, _commits(base), version).where(F.col(BUCKET) == _ALL).first()
    return json.loads(row["note"])


def previous(spark: SparkSession, base: str, version: int, buckets: int | None = None) -> tuple[int, int] | None:
    """(version, bucket count) that a batch builds on. ``buckets``, if given,
    must be the state's own number: rows would otherwise be looked for
    elsewhere."""
    v = io.latest_version(spark, _commits(base), before=version)
    if v is None:
        return None
    n = notes(spark, base, v)["buckets"]
    if buckets is not None and buckets != n:
        raise ValueError(f"the state at {base} has {n} buckets, not {buckets}")
    return v, n


def newest(spark: SparkSession, base: str, version: int) -> DataFrame:
    """(bucket, v): the version that holds each bucket as of ``version``; at
    most MOST_BUCKETS rows, from the commits' own small tables."""
    paths = [io.version_path(_commits(base), v) for v in versions(spark, base) if v <= version]
    rows = spark.read.option("basePath", _commits(base)).schema(f"{BUCKET} int, note string, {VERSION} long").parquet(*paths)
    return rows.where(F.col(BUCKET) >= 0).groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION)).where(F.col(VERSION) <= version)


def read(spark: SparkSession, base: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
    """The state as of ``version`` (default: the latest committed one),
    optionally only some buckets; None if there is no state."""
    v = version if version is not None else io.latest_version(spark, _commits(base))
    if v is None:
        return None
    schema = T.StructType.fromJson(json.loads(notes(spark, base, v)["schema"]))
    folder = f"{base.rstrip('/')}/rows"
    fs, path = io._fs(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    held = newest(spark, base, v)
    if only is not None:
        held = held.join(F.broadcast(only), BUCKET, "left_semi")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(VERSION, T.LongType())])) \
        .parquet(folder)
    # at most MOST_BUCKETS rows are broadcast; they prune the partitions that are scanned
    return rows.join(F.broadcast(held), [BUCKET, VERSION], "left_semi").select(*schema.names)


def write(rows: DataFrame, base: str, version: int, key: str, buckets: int, only: DataFrame, note: dict | None = None,
          schema: T.StructType | None = None) -> None:
    """Write ``rows``, all rows of the buckets ``only``, as ``version``.
    ``schema`` is the state's own, whose order of columns stays."""
    spark = rows.sparkSession
    kept = rows.select(*schema.names) if schema is not None else rows
    placed = kept.withColumn(BUCKET, bucket_of(F.col(key), buckets)).withColumn(VERSION, F.lit(version).cast("long"))
    (placed.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET, VERSION).parquet(f"{base.rstrip('/')}/rows"))
    said = json.dumps({**(note or {}), "buckets": buckets, "schema": kept.schema.json()})
    commit = only.select(F.col(BUCKET).cast("int").alias(BUCKET), F.lit(None).cast("string").alias("note")) \
        .unionByName(spark.range(1).select(F.lit(_ALL).alias(BUCKET), F.lit(said).alias("note")))
    io.write_snapshot(commit, _commits(base), version)


def create(df: DataFrame, base: str, key: str, buckets: int | None = None, version: int = 0) -> None:
    """A state with every bucket written (by default as version 0)."""
    rows = df if buckets else df.persist()  # counted, then written
    try:
        n = buckets or bucket_count(rows.count())
        write(rows, base, version, key, n, df.sparkSession.range(n).select(F.col("id").cast("int").alias(BUCKET)))
    finally:
        if not buckets:
            rows.unpersist()


def superseded(spark: SparkSession, base: str, keep: int = 2) -> DataFrame | None:
    """(bucket, v): partitions that neither the ``keep`` latest versions nor a
    retry of their successors read. They may be removed by a storage rule;
    nothing does so implicitly."""
    vs = versions(spark, base)
    if len(vs) <= max(keep, 2):
        return None
    oldest = vs[-max(keep, 2)]
    paths = [io.version_path(_commits(base), v) for v in vs if v <= oldest]
    written = spark.read.option("basePath", _commits(base)).schema(f"{BUCKET} int, note string, {VERSION} long").parquet(*paths) \
        .where(F.col(BUCKET) >= 0).select(BUCKET, VERSION)
    return written.join(newest(spark, base, oldest), [BUCKET, VERSION], "left_anti")


# --- source tables by the product's bucket (X2) -----------------------------------

#: Tables of the catalog that are stored by product.
BY_PRODUCT = ("products", "product_colors", "product_variants", "reviews")


def store_by_product(tables, base: str, buckets: int) -> None:
    """The catalog's source tables as Parquet partitioned by the bucket of
    their product. A variant lies with its colour's product, since the catalog
    looks variants up by colour; one without a colour with its own."""
    of_color = tables["product_colors"].select(F.col("id").alias("color_id"), F.col("product_id").alias("_owner")) \
        .groupBy("color_id").agg(F.min("_owner").alias("_owner"))
    variants = tables["product_variants"].join(of_color, "color_id", "left") \
        .withColumn("_owner", F.coalesce("_owner", "product_id"))
    owner = {"products": "id", "product_colors": "product_id", "product_variants": "_owner", "reviews": "product_id"}
    for name in BY_PRODUCT:
        df = variants if name == "product_variants" else tables[name]
        placed = df.withColumn(BUCKET, bucket_of(F.col(owner[name]), buckets)).drop("_owner")
        placed.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{base}/{name}")
    tables["categories"].write.mode("overwrite").parquet(f"{base}/categories")


def tables_by_product(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of ``store_by_product``, with their bucket column."""
    return {n: spark.read.parquet(f"{base}/{n}") for n in (*BY_PRODUCT, "categories")}
