import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import CLASHES, DOC_SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), DOC_SCHEMA)
    return df.select("*", *[F.lit("own").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
