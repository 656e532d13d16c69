import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, small, oracle, same, name):
    same(catalogue.QUERIES[name](spark, small), oracle.sql(catalogue.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
