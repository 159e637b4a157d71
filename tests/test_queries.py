"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from buildlens.plans.oracle import ORACLE
from buildlens.plans.queries import QUERIES
from tests.compare import DATA, compare, duck

ORACLES = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["run_id", "status"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, queries()[name], ORACLES[name], DATA) is None
