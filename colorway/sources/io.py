"""Sources and sinks.

Snapshots (S3) are versioned folders ``<base>/v=<NNNNNNNNNN>``; a version is
visible once Spark's job commit has written its ``_SUCCESS`` marker, and
readers take the highest committed version, so no reader sees a partial one.
A rerun of the same version overwrites only its own folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.session import source_bytes
from colorway.sources.schemas import BUCKETED_BY, MISFIT, ORDER_REQUEST_TEXT, SCHEMAS, STORED

VERSION_DIGITS = 10

# Fixed value: event-time text in JSON feeds keeps microseconds (Spark's
# default JSON format writes milliseconds only).
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


# --- S1 ------------------------------------------------------------------------

# Bytes of the tables read for each bucket that is stored: one task sorts a
# bucket, and rows are several times larger there than in their source.
SOURCE_BYTES_PER_BUCKET = 32 * 1024 * 1024


def bucket_count(least: int, *frames: DataFrame, bytes_each: int = SOURCE_BYTES_PER_BUCKET) -> int:
    """The number of buckets for tables that meet: ``least``, doubled until a
    bucket has at most ``bytes_each`` of what the tables read (a metadata read
    on the driver), so a bucket does not grow with the input."""
    size, n = sum(source_bytes(df) for df in frames), least
    while n * bytes_each < size:
        n *= 2
    return n


def scan_table(spark: SparkSession, directory: str, name: str, buckets: int | None = None) -> DataFrame:
    """A shop table stored as parquet, read under its fixed schema.
    ``buckets``: the table was stored in so many (``store_table``), so joins
    and aggregates on its bucket column need no shuffle of it."""
    path = f"{directory.rstrip('/')}/{name}"
    if not buckets:
        return spark.read.schema(STORED[name]).parquet(path)
    key = BUCKETED_BY[name]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED[name].fields)
    table = f"scan_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")  # the name only; the DataFrame keeps the files and their layout


def store_table(df: DataFrame, directory: str, name: str, buckets: int | None = None) -> None:
    """A shop table as parquet under its stored schema; columns it lacks are
    NULL. With ``buckets`` it is bucketed and sorted by its join column, a
    file for each bucket: choose a multiple of the cluster's cores that keeps
    files at a few hundred MB, and the same number for tables that meet."""
    path = f"{directory.rstrip('/')}/{name}"
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED[name].fields])
    if not buckets:
        rows.write.parquet(path)
        return
    key, table = BUCKETED_BY[name], f"store_{uuid.uuid4().hex}"
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    rows.sparkSession.sql(f"DROP TABLE {table}")


# --- S3: versioned snapshots ------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={version:0{VERSION_DIGITS}d}"


def committed_versions(spark: SparkSession, base: str) -> list[int]:
    fs, root = _fs(spark, base)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, base: str, before: int | None = None) -> int | None:
    vs = [v for v in committed_versions(spark, base) if before is None or v < before]
    return vs[-1] if vs else None


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> str:
    """S3: write ``df`` whole as ``version``; readers switch when it commits."""
    path = version_path(base, version)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, version: int | None = None,
                  before: int | None = None, schema=None) -> DataFrame | None:
    """The given version, else the latest committed one (below ``before``).
    Pass the written ``schema`` to read partition columns back as written."""
    v = version if version is not None else latest_version(spark, base, before)
    if v is None:
        return None
    reader = spark.read.option("basePath", version_path(base, v))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(version_path(base, v))


# --- S4 / S5 / S7: feeds -----------------------------------------------------------

def change_feed(spark: SparkSession, path: str, tables=None, streaming: bool = True) -> DataFrame:
    """Stream of row changes (JSON files), optionally limited to tables;
    ``streaming=False`` reads the same files as a batch."""
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(SCHEMAS["change_feed"]).json(path)
    return df.where(F.col("table_name").isin(*tables)) if tables else df


def payment_feed(spark: SparkSession, path: str, streaming: bool = True, max_files: int | None = None) -> DataFrame:
    """Stream of raw webhook calls: signature, timestamp, raw body;
    ``streaming=False`` reads the same files as a batch."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema("event_id bigint, delivery int, signature string, ts string, body string").json(path)


def order_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Checkout requests, one JSON body a line: the request's fields with
    numbers as text, the body as ``raw``, and ``misfit``: the body of a line
    that is no JSON object, is cut off, or has a field of another shape. No
    line is lost but blank ones.

    The parsed body leaves a generator, which gives one row a line: a filter
    on its fields stays above it and does not parse the line again for every
    field that it names."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path).where(F.trim("value") != "")
    request = F.from_json("value", ORDER_REQUEST_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MISFIT})
    read = lines.select(F.col("value").alias("raw"), F.explode(F.array(request)).alias("r"))
    # a list of one object would be read as that object
    misfit = F.when(F.col("r").isNull() | ~F.ltrim("raw").startswith("{"), F.col("raw")).otherwise(F.col(f"r.{MISFIT}"))
    return read.select("raw", *[F.col(f"r.{f.name}").alias(f.name) for f in ORDER_REQUEST_TEXT.fields if f.name != MISFIT],
                       misfit.alias(MISFIT))


def cart_event_feed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of cart events (parquet files) for X5."""
    r = spark.readStream.schema(SCHEMAS["cart_events"])
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def write_json_feed(df: DataFrame, path: str) -> None:
    """Write rows as JSON feed files with full-precision event times."""
    (df.write.option("timestampNTZFormat", JSON_TS_FORMAT).option("timestampFormat", JSON_TS_FORMAT)
       .json(path))


# --- S6 --------------------------------------------------------------------------

def append_rows(df: DataFrame, path: str, batch: str) -> None:
    """Append sink (newsletter e-mails, addresses, orders, items). Rows go
    to a folder of their ``batch`` (an id that a rerun gives again), so a
    rerun replaces its own rows and adds none twice."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of an append sink."""
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/batch=*")
