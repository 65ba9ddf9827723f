"""The queries that SQL can express, against it."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))


def test_queries_match_sql(spark):
    from check_oracle import compare

    from colorway.llm.oracle import oracle_sql
    report = compare(spark, "/root/testdata/sf0.01", set(oracle_sql()))
    assert len(report) == len(oracle_sql()) and all(r["ok"] for r in report.values()), report


def test_every_operator_and_the_pipeline():
    from colorway.llm.queries import queries
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]) if n.startswith("op") else 99)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
