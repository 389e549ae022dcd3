"""Registered queries beside DuckDB on whole small tables."""

import os

import duckdb
import pytest

from compare import difference
from convoyspark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches(spark, duck, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), duck, queries.ORACLES[name]) is None


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
