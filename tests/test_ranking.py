"""Picks by rank where values lie unevenly."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textsieve.operators.ranking import at_rank, mark_first

FAR = 9_000_000_000_000_000_000


@pytest.fixture(scope="module")
def uneven(spark):
    """One far outlier on both sides, a third of a group on one key, null keys, a null group, a group without keys."""
    rows = [("a", FAR, 900), ("a", -FAR, 901)]
    rows += [("a", 1_000 if i % 3 == 0 else 2_000 + i % 50, i) for i in range(300)]
    rows += [("a", None, 400 + i) for i in range(60)]
    rows += [("b", None, 500 + i) for i in range(40)] + [("c", 7, 600)]
    rows += [(None, i, 700 + i) for i in range(5)]
    return spark.createDataFrame(rows, "g string, k long, id long").persist()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.33, 0.5, 0.9, 1.0])
def test_first_rows_equal_the_plain_window(uneven, share):
    order = W.partitionBy("g").orderBy(F.col("k").asc_nulls_last(), "id")
    quota = F.floor(F.col("group_size") * share)
    plain = uneven.withColumn("group_size", F.count(F.lit(1)).over(W.partitionBy("g"))).withColumn(
        "chosen", F.col("g").isNotNull() & (F.row_number().over(order) <= quota)
    )
    expected = {(r.g, r.k, r.id): r.chosen for r in plain.collect()}
    got = mark_first(uneven, ["g"], F.col("k"), "id", quota, buckets=4, most=3).collect()
    assert len(got) == len(expected) and {(r.g, r.k, r.id): r.chosen for r in got} == expected


def test_repeated_rows_count_one_by_one(spark):
    rows = spark.createDataFrame([("a", 1, 1)] * 5 + [("a", 2, 2)] * 5, "g string, k long, id long")
    got = mark_first(rows, ["g"], F.col("k"), "id", F.lit(7), buckets=2, most=1)
    assert sorted((r.k, r.chosen) for r in got.collect()) == [(1, True)] * 5 + [(2, False)] * 3 + [(2, True)] * 2


def test_no_rows(spark, uneven):
    assert mark_first(uneven.where("false"), ["g"], F.col("k"), "id", F.lit(3)).count() == 0


def test_values_at_ranks(spark):
    """Doubles over the whole range, several ranks of a group, a null group."""
    values = sorted([-1.7e308, 1.7e308, 0.5] + [1.0 + i * 1e-9 for i in range(200)] + [3.0] * 100)
    rows = spark.createDataFrame([(g, v) for g in ("a", None) for v in values], "g string, v double")
    ranks = [1, 2, 50, 203, 204, 303]
    wanted = spark.createDataFrame([(g, r) for g in ("a", None) for r in ranks], "g string, _rank long")
    got = {(r.g, r["_rank"]): (r["_at"], r["_rest"]) for r in at_rank(rows, ["g"], "v", wanted, buckets=4, most=2).collect()}
    assert got == {(g, r): (values[r - 1], r - values.index(values[r - 1])) for g in ("a", None) for r in ranks}
