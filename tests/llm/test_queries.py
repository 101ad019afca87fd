"""The subpackage's queries run on the smallest tables and agree with SQL."""

import pytest

from gleanery.llm.queries import QUERIES, SQL
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    if name in SQL:
        assert_same(df, connect(data_dir), SQL[name])
    else:
        df.collect()
