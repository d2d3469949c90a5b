"""Every catalogue query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import plain

from loomspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns) > 0
    else:
        assert plain(found) == plain(duck.execute(sql).df())
