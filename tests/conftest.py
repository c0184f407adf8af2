"""Session and small data directories for the tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tesela.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("works", "authorships", "author_profiles", "snii_historico", "snii_llm_verified_matches", "deleted_works", "institutions", "raw_records", "documents", "embeddings")


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    """All tables without rows."""
    base = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """The smallest tables plus a row of nulls, repeated rows, and extra columns with names that operators use inside."""
    base = str(tmp_path_factory.mktemp("edge"))
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        rows = df.unionByName(nulls)
        if t != "documents":
            rows = rows.unionByName(df.limit(50))
        rows.withColumns({c: F.lit("x") for c in ("key", "value", "n", "term", "item", "size", "rank") if c not in df.columns}).write.parquet(f"{base}/{t}.parquet")
    return base


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)
