"""Every query of the engine with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from quakeframe import plans
from tests.compare import DATA, connection, difference

SF = "sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(plans.queries()[name](spark, f"{DATA}/{SF}"), con, plans.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, f"{DATA}/{SF}").count() > 0
