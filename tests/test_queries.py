"""Every query with SQL gives the rows of its SQL; the others run and give a stable schema."""

import os

import pytest

from compare import difference
from sievework.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, registry.queries()[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    frame = registry.queries()[name](spark, FOLDER)
    assert frame.columns and frame.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
