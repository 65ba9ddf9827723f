"""Canonical flat forms of nested results, for engine-independent checks.

Arrays of structs become one string: fields joined by ':', entries by '|',
NULL fields skipped (the rule of ``concat_ws`` in Spark and DuckDB alike).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry_text(*fields: Column) -> Column:
    return F.concat_ws(":", *[f.cast("string") for f in fields])


def array_text(arr: Column, fields: list[str]) -> Column:
    """'a:b:c|a:b:c' of an array of structs; '' for an empty array."""
    return F.array_join(F.transform(arr, lambda e: entry_text(*[e[f] for f in fields])), "|")


def list_text(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)
