"""Every query that has SQL gives the rows DuckDB gives; every query runs and is not empty."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from siltworks.plans import registry  # noqa: E402
from siltworks.session import drop_scratch  # noqa: E402

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"equality_filters", "anti_join"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    ours = registry.QUERIES[name](spark, FOLDER).toPandas()
    theirs = con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert oracle.rows(ours) == oracle.rows(theirs)
    assert len(ours) or name in MAY_BE_EMPTY
    drop_scratch()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
