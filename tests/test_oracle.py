"""Every registered query with SQL gives the rows of its SQL twin."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, duck, name):
    assert compare(duck, entry.oracle_sql()[name], entry.queries()[name](spark, sf)) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"machine_id", "class_id", "is_alert", "temp_slope"} <= set(df.columns)


def test_all_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
