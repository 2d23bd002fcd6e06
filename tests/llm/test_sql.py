"""Corpus queries against their SQL in DuckDB."""

import pytest

from isochron.llm import queries

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, con, name):
    compare(con, queries.QUERIES[name](spark, SF), queries.SQL[name])
