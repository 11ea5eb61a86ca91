"""Every registered query against its SQL at the smallest scale."""

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402
from tracemesh.plans.check import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, con, sf_dir, name):
    good, note = compare(spark, con, sf_dir, name, driver.queries()[name], driver.oracle_sql()[name])
    assert good, note
