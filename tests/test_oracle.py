"""Every registered query beside its SQL statement, over the smallest test tables."""

import pytest

import __spark_entry__
from verification import compare, oracle, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle_connection(SF)


def test_every_query_has_a_statement():
    assert set(registry.registered()) == set(oracle.statements()) == set(registry.JOBS)
    assert set(registry.JOBS) <= set(__spark_entry__.queries()) & set(__spark_entry__.oracle_sql())


def test_entry_gives_the_monthly_report(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r.period for r in rows} <= {"1998-06", None}


@pytest.mark.parametrize("name", sorted(registry.JOBS))
def test_same_result(spark, con, name):
    assert compare.difference(registry.registered()[name](spark, SF), con, oracle.statements()[name]) is None
