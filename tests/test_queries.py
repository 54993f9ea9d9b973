"""Every registered query of the core library against DuckDB on the smallest tables."""

import pytest
from compare import compare, connect

from meridian.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, con, name):
    assert compare(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
