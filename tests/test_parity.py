"""Every query with SQL must equal DuckDB on the same tables."""

import compare
import pytest

from textsieve.plans.catalog import all_queries

CHECKED = {n: item for n, item in all_queries().items() if item.sql}


@pytest.fixture(scope="module")
def con(folder):
    return compare.duck(folder)


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_equal_to_sql(spark, con, folder, name):
    assert compare.compare(spark, con, CHECKED[name], folder) is None
