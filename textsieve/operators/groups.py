"""Group facts on rows, rejection reasons, block lists and corpus checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_words, word_count


def with_group_facts(df: DataFrame, keys: Sequence[str], **facts: Column) -> DataFrame:
    """Attach aggregates of the row's group.

    Aggregating first and joining back replaces a window over the group: the aggregate is
    combined map-side, and a hot key is split by the adaptive join.
    """
    keys = list(keys)
    per_group = df.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()])
    return join_null_safe(df, per_group, keys)


def join_null_safe(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null equals a null; the keys appear once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def minimum_words(n_words: Column, label: Column, minima: dict[str, int], default: int) -> Column:
    """Condition with a minimum that depends on the class."""
    least = F.lit(default)
    for name, n in minima.items():
        least = F.when(label == name, n).otherwise(least)
    return n_words >= least


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Reason of the first rule that holds, null when none does."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for cond, reason in rules])


def kept(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull())


def apply_block_list(df: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Attach the reason of a block list ``(key, reason)``; null for rows that stay."""
    return df.join(blocks, key, "left")


def unknown_blocks(df: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Block-list keys that match no row."""
    return blocks.join(df.select(key).distinct(), key, "left_anti")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    bad = repeated_keys(df, key).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is not unique: {bad[0][key]}")


def complete_pairs(df: DataFrame, group: str, label: str, expected: Sequence[str] = ("fake", "true")) -> DataFrame:
    """Per group: whether its labels are exactly ``expected``. Counting replaces collecting the list."""
    exact = F.count(F.lit(1)) == len(expected)
    for name in expected:
        exact = exact & (F.count_if(F.col(label) == name) == 1)
    return df.groupBy(group).agg(exact.alias("complete"))


def groups_all_long(df: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """Rows of groups in which every text has ``n`` words, cut to ``n``."""
    sized = df.withColumn("_n", word_count(text))
    good = sized.groupBy(group).agg(F.min("_n").alias("_least")).where(F.col("_least") >= n).select(group)
    return df.join(good, group, "left_semi").withColumn(text, first_words(text, n))


def groups_both_labels(df: DataFrame, group: str, label: str, text: str, n: int, n_labels: int = 2) -> DataFrame:
    """Rows of groups whose long enough texts cover ``n_labels`` labels, cut to ``n``."""
    long_rows = df.where(word_count(text) >= n)
    good = (
        long_rows.groupBy(group)
        .agg(F.count_distinct(label).alias("_labels"))
        .where(F.col("_labels") == n_labels)
        .select(group)
    )
    return df.join(good, group, "left_semi").withColumn(text, first_words(text, n))


def hold_out(df: DataFrame, source: str, held: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows without the held sources, and the rows of the held sources."""
    inside = F.col(source).isin(list(held))
    return df.where(~inside), df.where(inside)


def union_named(**frames: DataFrame) -> DataFrame:
    """One frame with a ``corpus`` column naming the part each row came from."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def choose_corpora(df: DataFrame, combo: Sequence[str], repeats: dict[str, int] | None = None) -> DataFrame:
    """Rows of the chosen parts; a part listed in ``repeats`` appears that many times."""
    times = F.lit(1)
    for name, k in (repeats or {}).items():
        times = F.when(F.col("corpus") == name, k).otherwise(times)
    picked = df.where(F.col("corpus").isin(list(combo)))
    return picked.select("*", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def parse_combo(combo: str) -> tuple[list[str], dict[str, int]]:
    """``a+b+extx3`` names the parts a, b and ext, the last one three times."""
    names, repeats = [], {}
    for part in combo.split("+"):
        name, mark, k = part.rpartition("x")
        if mark and k.isdigit() and name:
            names.append(name)
            repeats[name] = int(k)
        else:
            names.append(part)
    return names, repeats


def cut_lengths(df: DataFrame, text: str, lengths: Sequence[int] = (30, 50, 100), out: str = "cut") -> DataFrame:
    """Every row once per length with its text cut to that many words."""
    versions = F.array(*[F.struct(F.lit(n).alias("n"), first_words(text, n).alias("t")) for n in lengths])
    rest = [c for c in df.columns if c != text]
    spread = df.select(*rest, F.explode(versions).alias("_v"))
    return spread.select(*rest, F.col("_v.n").alias(out), F.col("_v.t").alias(text))
