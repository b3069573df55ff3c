"""Registered queries against their SQL, on the smallest tables."""

import oracle
import pytest

from tabstrata.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_same_values(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = oracle.duck(small).execute(SQL[name]).fetchdf()
    assert len(want) > 0
    assert oracle.differences(got, want) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
