"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    fn = queries()[name]
    if name not in SQL:
        df = fn(spark, FOLDER)
        assert df.columns and df.count() > 0
        return
    ok, note = compare(spark, con, FOLDER, name, fn, SQL[name])
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0
