"""Every registered query against its SQL counterpart, over the smallest given tables."""

from pathlib import Path

import pytest
from check_oracle import check, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, tables, name):
    problem, rows, _ = check(spark, tables, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None
    assert rows > 0


def test_sql_has_no_orphans():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 40
