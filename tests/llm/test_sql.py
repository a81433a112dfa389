"""Registered queries against their SQL twins on the smallest tables; the guard of the entry points."""

import pytest

import __spark_entry__ as entry_points
from larder.llm import catalog
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_one_query_per_operator():
    names = entry_points.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert set(entry_points.oracle_sql()) <= set(names)
