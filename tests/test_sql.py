"""Every registered query against its SQL on the small tables."""

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), SQL[name], con) is None


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_one_row_per_repository(spark):
    out = entry.entry(spark)
    assert out.columns == ["repo_id", "framework", "confidence", "score", "indicators"]
    assert out.count() == 20
