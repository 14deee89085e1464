"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

spec = importlib.util.spec_from_file_location("oracle", os.path.join(os.path.dirname(__file__), "oracle.py"))
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, good = oracle.compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert good is not False, message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].n >= rows[-1].n


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
