"""Leak-free splits: by recency, by seeded pick, by class rule, and grouped folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import hash_key, mark_first

SHARE = 0.3
TRAIN, VALIDATION = "treino", "val"


def _quota(share: float) -> Column:
    return F.bround(F.lit(share) * F.col("group_size"), 0)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("chosen"), VALIDATION).otherwise(TRAIN)).drop("chosen")


def recency_split(df: DataFrame, group: str, ts: str, identity: str, share: float = SHARE) -> DataFrame:
    """Newest share of every group to validation; rows without a time come last."""
    return _named(mark_first(df, [group], -F.unix_micros(F.col(ts).cast("timestamp")), identity, _quota(share)))


def random_split(df: DataFrame, group: str, identity: str, share: float = SHARE, seed: int = 42) -> DataFrame:
    return _named(mark_first(df, [group], hash_key(seed, identity), identity, _quota(share)))


def split_by_class(
    df: DataFrame, group: str, label: str, ts: str, identity: str, by_time: str = "fake", share: float = SHARE,
    seed: int = 42,
) -> DataFrame:
    """Groups that open with the class ``by_time`` are split by recency, the others by seeded pick."""
    mode = df.groupBy(group).agg(F.min_by(label, identity).alias("_mode"))
    rows = df.join(mode, group, "left")
    newest = -F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.when(F.col("_mode") == by_time, newest).otherwise(hash_key(seed, identity))
    return _named(mark_first(rows, [group], key, identity, _quota(share))).drop("_mode")


STRATA = 10


def grouped_folds(
    df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42, classes: Sequence[str] = ("fake", "true")
) -> DataFrame:
    """Fold per group; groups are never split, and a null group is a group.

    One running number over all groups, ordered by the share of the first class in tenths, by size
    (largest first) and by seeded hash, is dealt out modulo ``k``: every fold gets as many groups as
    any other, give or take one, with alike shares and sizes. The work is done on one row per group.
    The number is a prefix sum in three levels (share and size, hash bucket, rank inside a bucket), so
    many groups of one size are not sorted in one task.
    """
    labelled = F.count_if(F.col(label).isin(*classes))
    share = F.floor(STRATA * F.count_if(F.col(label) == classes[0]) / F.greatest(labelled, F.lit(1)))
    groups = df.groupBy(group).agg(share.alias("_s"), (-F.count(F.lit(1))).alias("_z"))
    groups = groups.withColumn("_h", hash_key(seed, group)).withColumn("_b", F.shiftright("_h", 36))
    cells = groups.groupBy("_s", "_z", "_b").agg(F.count(F.lit(1)).alias("_n"))
    outer = cells.groupBy("_s", "_z").agg(F.sum("_n").alias("_m"))
    over = outer.select("_s", "_z", (F.sum("_m").over(W.orderBy("_s", "_z")) - F.col("_m")).alias("_over"))
    before = F.sum("_n").over(W.partitionBy("_s", "_z").orderBy("_b")) - F.col("_n")
    starts = cells.select("_s", "_z", "_b", before.alias("_before")).join(over, ["_s", "_z"])
    inside = F.row_number().over(W.partitionBy("_s", "_z", "_b").orderBy("_h", group)) - 1
    numbered = groups.withColumn("_i", inside).join(starts, ["_s", "_z", "_b"])
    return numbered.select(group, ((F.col("_over") + F.col("_before") + F.col("_i")) % k).cast("int").alias("fold"))
