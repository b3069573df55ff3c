"""Every query that SQL can express, compared value by value on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", list(SQL))
def test_same_values(spark, small, con, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert len(want) > 0
    assert oracle.differences(got, want) == []


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
