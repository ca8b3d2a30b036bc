"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = compare.rows_of_df(QUERIES[name](spark, data))
    if name in ORACLE:
        assert got == compare.rows_of_sql(compare.views(data), ORACLE[name])


def test_every_oracle_has_a_query():
    assert ORACLE.keys() <= QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]
