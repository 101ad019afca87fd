"""Every core query runs, and agrees with its SQL twin where there is one."""

import pytest

from gleanery.plans import catalog
from tests.compare import assert_same, connect

QUERIES, SQL = catalog.queries(), catalog.sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, con, name):
    df = QUERIES[name](spark, data_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        df.collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
