"""Every query of the engine's own operators against SQL on the same tables."""

import pytest

from apisieve.plans import catalogue_queries, queries
from tests.conftest import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, duck, name):
    assert table(queries.QUERIES[name](spark, sf_dir).toPandas()) == table(duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue_queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, sf_dir, name):
    assert catalogue_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(queries.QUERIES) <= set(entry.queries())
