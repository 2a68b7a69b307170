"""Queries that use the same facts of the texts many times read the texts once."""

import pytest

from textsieve.plans.catalog import all_queries


@pytest.mark.parametrize("name", ["temporal_variants", "unit_weights"])
def test_result_does_not_read_the_texts_again(spark, name):
    df = all_queries()[name].run(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0 and "regexp" not in plan
    assert not any("documents.parquet" in f for f in df.inputFiles())
