"""Every query over the event streams against its SQL twin, or for its columns and row count."""

import pytest
from compare import connect, same
from conftest import SMALL

from lagweave.plans.registry import FLAGSHIP, QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_without_the_text_subpackage():
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
