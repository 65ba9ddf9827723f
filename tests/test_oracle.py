"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_all_queries_match_oracle(spark):
    from check_oracle import compare
    from colorway.plans.queries import queries
    rep = compare(spark, SF, set(queries()))
    bad = {k: v for k, v in rep.items() if not v["ok"]}
    assert not bad, bad


def test_every_query_has_an_oracle():
    from colorway.plans.oracle import oracle_sql
    from colorway.plans.queries import queries
    assert set(oracle_sql()) == set(queries())


def test_entry_smoke(spark):
    """The driver's smoke check: the flagship on sf0.001, rows > 0, the same
    schema on every call."""
    import __spark_entry__ as e
    a, b = e.entry(spark), e.entry(spark)
    assert a.count() > 0 and a.schema == b.schema
    assert {"color_id", "product_id", "sizes", "all_colors", "rating_tenths", "has_stock"} <= set(a.columns)
