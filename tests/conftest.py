import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from colorway.session import local_session
    s = local_session(4, app="colorway-tests")
    yield s


@pytest.fixture
def scratch():
    """A fresh scratch folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="colorway-test-", dir="/tmp")


def frame(spark, name, rows):
    """A shop table from hand-made rows (dicts; missing columns are NULL)."""
    from colorway.sources.schemas import SCHEMAS
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **rows):
    names = ["products", "product_colors", "product_variants", "categories", "reviews", "users",
             "sizes", "order_items"]
    out = {n: frame(spark, n, rows.get(n, [])) for n in names}
    for n, r in rows.items():
        if n not in out:
            out[n] = frame(spark, n, r)
    return out
