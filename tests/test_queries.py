"""Every query that has SQL agrees with DuckDB over the smallest shared tables; every other one runs."""

from pathlib import Path

import pytest

from slidespark import registry

from .differential import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
