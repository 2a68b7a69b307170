"""Exact picks and ranks that never pull a whole group, or the whole table, into one task.

A plain ``row_number`` over a group sorts the group in a single task. Here a histogram finds the bucket
in which the border falls, and is refined there until few rows are left; only those are sorted. The
result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut_lineage
from .groups import join_null_safe

BUCKETS = 4096
HASH_DIGITS = 12
#: Rows of a bucket that one task may sort.
OPEN_ROWS = 100_000


def hash_key(seed: int | str, identity) -> Column:
    """48 bits of an md5 over ``seed:id`` as a long: a seeded shuffle any engine can repeat."""
    ident = F.col(identity) if isinstance(identity, str) else identity
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), ident.cast("string")))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def at_rank(
    rows: DataFrame, groups: Sequence[str], value: str, wanted: DataFrame, buckets: int = BUCKETS, most: int = OPEN_ROWS
) -> DataFrame:
    """Value at given ranks of every group, however unevenly its values lie.

    ``rows`` hold the groups and a long or finite double without nulls; ``wanted`` the groups and ``_rank``, from 1 up to
    the group's size. A histogram of the interval that holds the rank is taken again and again, each time of the bucket
    found before, until that bucket holds ``most`` rows or a single value; so neither outliers nor a value shared by
    many rows leave a large bucket to sort. Returns groups, ``_rank``, ``_at`` and ``_rest``, the number of rows equal to
    ``_at`` among the first ``_rank``. Null groups are groups.
    """
    groups = list(groups)
    per = W.partitionBy(*groups, "_rank")

    def gap(high: Column, low: Column) -> Column:
        if isinstance(rows.schema[value].dataType, T.DoubleType):
            return high / 2 - low / 2
        return (high.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double")

    def narrowed(state: DataFrame, bucket: Column) -> DataFrame:
        """The bucket of every open interval in which its rank falls."""
        inside = join_null_safe(rows, state, groups).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
        filled = inside.groupBy(*groups, "_rank", bucket.alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_rest").alias("_rest")
        )
        before = filled.withColumn("_before", F.sum("_n").over(per.orderBy("_bucket")) - F.col("_n"))
        rest = F.col("_rest") - F.col("_before")
        return before.where((rest > 0) & (rest <= F.col("_n"))).select(
            *groups, "_rank", rest.alias("_rest"), "_lo", "_hi", "_n"
        )

    ends = rows.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    state = join_null_safe(wanted.withColumn("_rest", F.col("_rank")), ends, groups)
    several = F.col("_lo") < F.col("_hi")
    large = several & (F.col("_n") > most)
    share = F.floor(gap(F.col(value), F.col("_lo")) / gap(F.col("_hi"), F.col("_lo")) * buckets)
    while state.where(large).limit(1).count():
        state = cut_lineage(state.where(~large).unionByName(narrowed(state.where(large), share)))
    found = state.where(~several).unionByName(narrowed(state.where(several), F.col(value)))
    return found.select(*groups, "_rank", F.col("_lo").alias("_at"), "_rest")


def mark_first(
    df: DataFrame,
    groups: Sequence[str],
    key: Column,
    tie: str,
    quota: Column,
    flag: str = "chosen",
    buckets: int = BUCKETS,
    most: int = OPEN_ROWS,
) -> DataFrame:
    """Flag the first ``quota`` rows of every group in the order ``(key nulls last, tie)``.

    ``key`` is a long; ``quota`` is an expression over ``group_size``; ``tie`` is an integer id. The border row of a group
    is found on keys and ties alone: the key at the rank, then the tie among rows of that key. Whole rows only
    meet one border per group. Repeated rows of one id count one by one. Rows with a null group are kept and not flagged.
    """
    groups = list(groups)
    rows = df.withColumns({"_key": key, "_tie": F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63)))})
    narrow = rows.select(*groups, "_key", "_tie").dropna(subset=groups).persist()
    try:
        sizes = narrow.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_size"), F.count("_key").alias("_keyed"))
        sizes = sizes.withColumn("_quota", quota.cast("long"))
        cut = sizes.where((F.col("_quota") > 0) & (F.col("_quota") < F.col("group_size")))
        wanted = cut.where(F.col("_quota") <= F.col("_keyed")).select(*groups, F.col("_quota").alias("_rank"))
        keys = at_rank(narrow.where(F.col("_key").isNotNull()).drop("_tie"), groups, "_key", wanted, buckets, most)
        unkeyed = cut.where(F.col("_quota") > F.col("_keyed")).select(
            *groups, F.lit(None).cast("long").alias("_at"), (F.col("_quota") - F.col("_keyed")).alias("_rest")
        )
        edges = cut_lineage(keys.select(*groups, "_at", "_rest").unionByName(unkeyed))
        level = join_null_safe(narrow, edges, groups).where(F.col("_key").eqNullSafe(F.col("_at"))).select(*groups, "_tie")
        ties = at_rank(level, groups, "_tie", edges.select(*groups, F.col("_rest").alias("_rank")), buckets, most)
        ties = ties.select(*groups, F.col("_at").alias("_tie_at"), F.col("_rest").alias("_last"))
        whole = (F.col("_quota") >= F.col("group_size")).alias("_whole")
        borders = cut_lineage(
            sizes.select(*groups, whole).join(edges.drop("_rest"), groups, "left").join(ties, groups, "left")
        )
    finally:
        narrow.unpersist()
    placed = rows.join(borders, groups, "left")
    same_key = F.col("_key").eqNullSafe(F.col("_at")) & F.col("_tie_at").isNotNull()
    on_border = same_key & (F.col("_tie") == F.col("_tie_at"))
    earlier = F.when(F.col("_at").isNull(), F.col("_key").isNotNull()).otherwise(F.col("_key") < F.col("_at"))
    before = F.col("_tie_at").isNotNull() & (earlier | (same_key & (F.col("_tie") < F.col("_tie_at"))))
    settled = placed.where(~F.coalesce(on_border, F.lit(False))).withColumn(
        flag, F.coalesce(F.col("_whole"), F.lit(False)) | F.coalesce(before, F.lit(False))
    )
    repeats = W.partitionBy(*groups).orderBy("_tie")
    border_rows = placed.where(on_border).withColumn(flag, F.row_number().over(repeats) <= F.col("_last"))
    return settled.unionByName(border_rows).select(*df.columns, flag)


def take_seeded(df: DataFrame, identity: str, n: Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in seeded order; ``n`` may be a scalar subquery over another table."""
    one = df.withColumn("_all", F.lit(0))
    picked = mark_first(one, ["_all"], hash_key(seed, identity), identity, n, "_chosen")
    return picked.where("_chosen").drop("_all", "_chosen")


def keep_first(df: DataFrame, key: Column, identity: str) -> DataFrame:
    """Keep the row with the smallest id for every key.

    Only fingerprints and ids are shuffled and they are pre-aggregated, so a key shared by a
    third of all rows costs one row per map task.
    """
    first = (
        df.select(F.sha2(key, 256).alias("_print"), F.col(identity))
        .groupBy("_print")
        .agg(F.min(identity).alias(identity))
        .select(identity)
    )
    return df.join(first, identity, "left_semi")


def running_sum(df: DataFrame, key: str, value: str, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over the rows of the group with a key at most this one.

    A two-level prefix sum. Rows fall into buckets that follow the key: linear steps, refined on a
    log scale towards both ends so that outliers do not squeeze the rest into one bucket. Only a
    bucket is sorted in one task; the running total over buckets sees one row per bucket.
    """
    groups = list(groups) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if groups == ["_all"] else df
    ends = rows.groupBy(*groups).agg(
        F.min(F.col(key).cast("double")).alias("_lo"), F.max(F.col(key).cast("double")).alias("_hi")
    )
    low, high = F.col(key).cast("double") - F.col("_lo"), F.col("_hi") - F.col(key).cast("double")
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    steps = F.struct(
        F.floor(low / span * BUCKETS).alias("a"),
        F.floor(F.log(F.lit(1e-12) + low / span) * 64).alias("b"),
        F.floor(-F.log(F.lit(1e-12) + high / span) * 64).alias("c"),
    )
    placed = rows.join(ends, groups).withColumn("_bucket", steps)
    totals = placed.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*groups).orderBy("_bucket")) - F.col("_sum")
    offsets = totals.select(*groups, "_bucket", before.alias("_offset"))
    inside = F.sum(value).over(W.partitionBy(*groups, "_bucket").orderBy(key))
    summed = placed.withColumn("_inside", inside).join(offsets, [*groups, "_bucket"])
    return summed.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(out))


def sequential_id(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Dense 0-based number in key order; ``key`` is unique and numeric."""
    counted = running_sum(df.withColumn("_one", F.lit(1)), key, "_one", "_upto")
    return counted.withColumn(out, F.col("_upto") - 1).drop("_one", "_upto")


def carry_forward(df: DataFrame, groups: Sequence[str], position: str, value: str, out: str, span: int = 4096):
    """Last non-null ``value`` at or before each row of the group.

    The group is cut into spans of positions. Each span is filled on its own and starts from the
    last value of the spans before it, so a very long group is shared by many tasks.
    """
    groups = list(groups)
    spanned = df.withColumn("_span", F.floor(F.col(position) / span))
    last = (
        spanned.where(F.col(value).isNotNull())
        .groupBy(*groups, "_span")
        .agg(F.max_by(value, position).alias("_last"))
    )
    spans = spanned.select(*groups, "_span").distinct().join(last, [*groups, "_span"], "left")
    earlier = W.partitionBy(*groups).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(
        *groups, "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_start")
    )
    here = W.partitionBy(*groups, "_span").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    filled = spanned.withColumn("_seen", F.last(value, ignorenulls=True).over(here))
    return (
        filled.join(starts, [*groups, "_span"])
        .withColumn(out, F.coalesce("_seen", "_start"))
        .drop("_span", "_seen", "_start")
    )
