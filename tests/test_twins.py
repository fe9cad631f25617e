"""Every named query against its SQL twin; queries without one must give rows."""

import pytest
from check_twins import compare, connect

import __spark_entry__ as contract

TWINS = contract.oracle_sql()
SLOW_WITHOUT_TWIN = {"gbt_search"}


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, con, medium, name):
    ok, text = compare(spark, con, medium, name, contract.queries()[name], TWINS[name])
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(TWINS) - SLOW_WITHOUT_TWIN))
def test_query_gives_rows(spark, medium, name):
    assert contract.queries()[name](spark, medium).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 15
