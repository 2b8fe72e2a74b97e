"""Every registered core query: against its SQL where it has one, else that it runs and gives rows."""

import os

import pytest

from sparsemill import plans

from compare import assert_same, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    if name in plans.ORACLES:
        assert_same(spark, con, SF, plans.QUERIES[name], plans.ORACLES[name])
    else:
        assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_has_all_names():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
