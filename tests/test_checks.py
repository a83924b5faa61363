"""Every registered query with an oracle, compared with DuckDB on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import CHECKS
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql is not None])
def test_oracle(spark, con, name):
    assert compare(spark, con, CHECKS[name], SF)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
