"""Number-rate features: counts, rates and rates smoothed by the training prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.numbers import number_counts, smoothed_rate

COUNTED = ["n_numbers", *fx.NUMBER_CATEGORIES]
MODES = ("count", "pct", "smooth", "categories", "length")


def counted(df: DataFrame, text: str, spelled: Sequence[str] = fx.NUMBER_WORDS) -> DataFrame:
    """Add the number counts of each text as columns."""
    return df.withColumn("_k", number_counts(text, spelled)).select("*", "_k.*").drop("_k")


def priors(counts: DataFrame) -> DataFrame:
    """One row with the overall rate of every category in the training texts."""
    n = F.greatest(F.sum("n_words"), F.lit(1))
    return counts.agg(*[(F.sum(k) / n).alias(k) for k in COUNTED])


class NumberRates:
    """Fitted rates; ``mode`` is one of ``MODES``. Only the priors are learned, from training rows."""

    def __init__(self, mode: str = "pct", m: float = 20.0):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.mode, self.m, self.prior = mode, m, {k: 0.0 for k in COUNTED}

    def fit(self, counts: DataFrame) -> NumberRates:
        if self.mode in ("smooth", "categories"):
            self.prior = priors(counts).collect()[0].asDict()
        return self

    @property
    def names(self) -> list[str]:
        return [f"rate_{k}" for k in COUNTED] if self.mode == "categories" else ["rate"]

    def columns(self) -> list[Column]:
        n = F.greatest(F.col("n_words"), F.lit(1))
        if self.mode == "count":
            return [F.col("n_numbers").cast("double").alias("rate")]
        if self.mode == "pct":
            return [(F.col("n_numbers") / n).alias("rate")]
        if self.mode == "smooth":
            return [smoothed_rate(F.col("n_numbers"), n, F.lit(self.prior["n_numbers"]), self.m).alias("rate")]
        if self.mode == "categories":
            return [smoothed_rate(F.col(k), n, F.lit(self.prior[k]), self.m).alias(f"rate_{k}") for k in COUNTED]
        return [F.log1p(F.col("n_words").cast("double")).alias("rate")]

    def transform(self, counts: DataFrame) -> DataFrame:
        return counts.select("*", *self.columns())
