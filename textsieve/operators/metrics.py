"""Evaluation from a table of labels and predictions.

Every metric is derived from the four confusion cells, so one map-side combined aggregate over
the predictions is all the data work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum

# Normal quantile of the 95% interval, bootstrap size and seed.
Z95 = 1.96
RESAMPLES = 2000
SEED = 42

CELLS = ["fake_as_fake", "fake_as_true", "true_as_fake", "true_as_true"]


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The four cells per key; no key gives one row."""
    y, p = F.col(label), F.col(predicted)
    cells = [
        F.count_if((y == a) & (p == b)).alias(f"{a}_as_{b}") for a in ("fake", "true") for b in ("fake", "true")
    ]
    return df.groupBy(*keys).agg(*cells)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def metric_columns() -> list[Column]:
    """Percent metrics over confusion cells; an undefined ratio counts as 0."""
    ff, ft, tf, tt = (F.col(c) for c in CELLS)
    n = ff + ft + tf + tt
    recall_fake, recall_true = _ratio(ff, ff + ft), _ratio(tt, tt + tf)
    f1_fake, f1_true = _ratio(2 * ff, 2 * ff + ft + tf), _ratio(2 * tt, 2 * tt + ft + tf)
    # A class without rows takes no part in the mean of recalls.
    present = F.when(ff + ft > 0, 1).otherwise(0) + F.when(tt + tf > 0, 1).otherwise(0)
    return [
        n.alias("n"),
        (_ratio(ff + tt, n) * 100).alias("accuracy"),
        ((f1_fake + f1_true) / 2 * 100).alias("f1_macro"),
        (_ratio(recall_fake + recall_true, present) * 100).alias("bal_acc"),
        (recall_fake * 100).alias("recall_fake"),
        (recall_true * 100).alias("recall_true"),
    ]


def evaluate(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return confusion(df, keys, label, predicted).select(*keys, *CELLS, *metric_columns())


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound, in percent, of a proportion."""
    p = hits / n
    shrink = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / shrink
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / shrink
    return (centre - half) * 100, (centre + half) * 100


def with_wilson(metrics: DataFrame) -> DataFrame:
    low, high = wilson(F.col("fake_as_fake") + F.col("true_as_true"), F.col("n"))
    return metrics.withColumn("acc_low", low).withColumn("acc_high", high)


def _intervals(seed: int, resamples: int):
    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = batch[CELLS].to_numpy(dtype=np.int64)
            rows = []
            for key, four in zip(batch["_key"], cells, strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
                ff, ft, tf, tt = rng.multinomial(four.sum(), four / four.sum(), size=resamples).T.astype(float)
                fake = 2 * ff / np.maximum(2 * ff + ft + tf, 1)
                true = 2 * tt / np.maximum(2 * tt + ft + tf, 1)
                rows.append((key, *np.quantile(50.0 * (fake + true), (0.025, 0.975))))
            yield pd.DataFrame(rows, columns=["_key", "f1_low", "f1_high"])

    return bounds


def bootstrap_f1(metrics: DataFrame, keys: Sequence[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Percentile interval of macro F1 by resampling rows.

    Resampling n rows with replacement draws the four cell counts from a multinomial, so a key costs
    one vectorised draw of all replicates, whatever the size of the table. Every key has a stream of
    its own.
    """
    key = F.to_json(F.struct(*keys)) if keys else F.lit("all")
    cells = metrics.where(F.col("n") > 0).select(key.alias("_key"), *CELLS)
    drawn = cells.mapInPandas(_intervals(seed, resamples), "_key string, f1_low double, f1_high double")
    return metrics.withColumn("_key", key).join(drawn, "_key", "left").drop("_key")


def source_accuracy(df: DataFrame, keys: Sequence[str], source: str, label: str = "label", predicted: str = "predicted"):
    """Accuracy and size per source in long form."""
    ok = (F.col(label) == F.col(predicted)).cast("double")
    return df.groupBy(*keys, source).agg((F.avg(ok) * 100).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with ties averaged.

    Rows collapse to one per distinct score before anything is ranked.
    """
    by_score = df.groupBy(*keys, score).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )
    below = running_sum(by_score, score, "_neg", "_neg_upto", keys)
    won = F.sum(F.col("_pos") * (F.col("_neg_upto") - F.col("_neg") / 2.0))
    sums = below.groupBy(*keys).agg(won.alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    area = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_won") / (F.col("_p").cast("double") * F.col("_n")))
    return sums.select(*keys, area.alias("auc"))


def full_metrics(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """All metrics with both intervals, one row per key."""
    return bootstrap_f1(with_wilson(evaluate(df, keys, label, predicted)), keys)


def with_overall(df: DataFrame, key: str, name: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Metrics per value of ``key`` and for all of them together, from one pass over the rows."""
    cells = confusion(df, [key], label, predicted)
    rolled = cells.rollup(key).agg(*[F.sum(c).alias(c) for c in CELLS], F.grouping(key).alias("_g"))
    named = rolled.withColumn(key, F.when(F.col("_g") == 1, name).otherwise(F.col(key)))
    return named.select(key, *CELLS, *metric_columns())


def errors(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.where(F.col(label) != F.col(predicted))


def two_population_recall(df: DataFrame, in_true: Column, in_fake: Column, predicted: str = "predicted") -> DataFrame:
    """Recall of true on one population and of fake on another, and their mean."""
    rt = F.avg(F.when(in_true, (F.col(predicted) == "true").cast("double"))) * 100
    rf = F.avg(F.when(in_fake, (F.col(predicted) == "fake").cast("double"))) * 100
    return df.agg(rt.alias("recall_true"), rf.alias("recall_fake")).withColumn(
        "bal_acc", (F.col("recall_true") + F.col("recall_fake")) / 2
    )
