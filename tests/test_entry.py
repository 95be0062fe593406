"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
LLM = {*(contract.llm.QUERIES if contract.llm else ()), "pipeline"}
QUERIES = {name: query for name, query in contract.queries().items() if name not in LLM}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("events", "region"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def rows(columns, values, in_order):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    found = [repr([row[i] for i in order]) for row in values]
    return found if in_order else sorted(found)


def is_ordered(sql):
    """Whether the SQL ends with an ORDER BY of its own."""
    return re.search(r"ORDER BY [^()]*$", sql) is not None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) - LLM


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, database, name):
    got = QUERIES[name](spark, SF_DIR)
    want = database.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    ordered = is_ordered(SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()], ordered) == rows(columns, want.fetchall(), ordered)


def test_flagship(spark):
    assert contract.entry(spark).columns == ["region", "averageRisk", "highestRisk", "measurements"]
