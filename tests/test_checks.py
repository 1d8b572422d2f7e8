"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import compare, duck
from checks.oracles import oracle_sql
from checks.queries import QUERIES
from __spark_entry__ import entry


@pytest.fixture(scope="module")
def con(tables):
    return duck(tables)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, tables, name):
    line = compare(spark, con, name, tables)
    assert not line.startswith("FAIL"), line
