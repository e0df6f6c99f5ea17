"""Every registered query against its SQL, run by DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
from mercato.catalog import REGISTRY

ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    expected = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    actual = sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
    assert actual == expected


def test_every_query_of_the_engine_has_sql():
    assert set(REGISTRY) <= set(ORACLES) <= set(contract.queries())


def test_entry_returns_months(spark):
    frame = contract.entry(spark)
    assert "business_health_status" in frame.columns
    assert frame.count() > 0
