"""Blending of score columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import standardize


def blend_scores(df: DataFrame, scores: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Mean of standardised scores as ``score``; ``fit_on`` holds out-of-fold training scores."""
    scaled = standardize(df, scores, fit_on)
    total: Column = F.lit(0.0)
    for name in scores:
        total = total + F.col(name) / len(scores)
    return scaled.withColumn("score", total)
