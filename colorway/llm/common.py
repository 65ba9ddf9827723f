"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colorway.session import lineage_cut, scratch_dir

__all__ = ["arrow_rows", "importable", "input_table", "lineage_cut", "row_mark", "scratch_table", "slices", "texts", "unused"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package.
    On a cluster without such a share, ship it with ``--py-files``."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds few texts as
    Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's text column; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def arrow_rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from plain lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has a column of a name
    (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_mark(df: DataFrame) -> Column:
    """128 bits of hash of a whole row, text of all columns and which are null:
    rows with equal marks are taken as equal throughout."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(F.lit(""), *[c.isNull().cast("int").cast("string") for c in columns])
    return F.struct(F.xxhash64(F.lit(1), nulls, *columns).alias("a"), F.xxhash64(F.lit(2), nulls, *columns).alias("b"))


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    folder = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
