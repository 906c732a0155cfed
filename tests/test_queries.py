"""Every query against its SQL counterpart; those without one must run."""

import pytest

from millrace.plans import catalogue
from tests.compare import assert_same, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert_same(got, connect(data).sql(SQL[name]).df())
    else:
        assert got.shape[1] > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
