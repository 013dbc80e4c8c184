"""Every registered query against its SQL on the smallest tables; the others must run."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["retailer", "finding", "url"]
    assert not df.isEmpty()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    diff, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert diff is None
