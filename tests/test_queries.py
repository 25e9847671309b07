"""Every query that has SQL gives the rows of that SQL; the others run."""

import pytest
from compare import same

from touchline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.collect() is not None
