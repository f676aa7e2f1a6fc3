"""The queries of the dealt operators against their SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from isochron.llm import queries
from tests.oracle import check

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, queries.queries()[name], SQL[name])


def test_a_query_for_each_operator():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= names
