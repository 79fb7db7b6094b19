"""Every query against its SQL on the smallest tables."""

import compare
import pytest
from rillflow.plans.catalog import CATALOG

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", list(CATALOG))
def test_agrees_with_sql(spark, db, name):
    assert compare.difference(spark, db, name, SMALL) is None


def test_entry_points_list_every_query():
    import __spark_entry__ as entry

    own = set(entry.queries()) - set(entry.EXTRA)
    assert own == set(CATALOG)
    assert own <= set(entry.oracle_sql())
