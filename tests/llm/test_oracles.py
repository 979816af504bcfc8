"""Queries that SQL can express, against DuckDB on the same tables."""

import zlib

import duckdb
import pytest

from comparison import oracle_rows, spark_rows
from provenant.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.catalogue_sql()))
def test_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(queries.catalogue()[name](spark, sf_dir)) == oracle_rows(oracles.catalogue_sql()[name], sf_dir)


@pytest.mark.parametrize("text", ["", "0", "123456789", "-7:straße", "é×÷ÿ"])
def test_crc_in_sql(text):
    got = duckdb.execute(f"select {oracles.crc32('t')} from (select cast(? as varchar) as t)", [text]).fetchone()[0]
    assert got == zlib.crc32(text.encode())
