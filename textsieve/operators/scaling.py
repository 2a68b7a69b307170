"""Class weights and standardisation as declarative aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * n_class)`` per class: one small aggregate."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per_class.agg(F.sum("_n").alias("n"))
    classes = per_class.agg(F.count(F.lit(1)).alias("k"))
    weight = total.scalar() / (classes.scalar() * F.col("_n")).cast("double")
    return per_class.select(label, weight.alias("weight"))


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1, fitted on ``fit_on``; a constant column stays centred."""
    columns = list(columns)
    source = df if fit_on is None else fit_on
    stats = source.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
    )
    out = df
    for c in columns:
        mean = stats.select(f"{c}_m").scalar()
        spread = stats.select(F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s"))).scalar()
        out = out.withColumn(c, (F.col(c) - mean) / spread)
    return out
