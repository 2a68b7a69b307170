"""Readers and the binding of the corpus notions to stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; naming the columns keeps the scan to those columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Text table. A file with a single row group is fanned out over the cores."""
    return spread(table(spark, folder, "documents", *(columns or ("doc_id", "text", "source"))), "doc_id")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    quality = F.col("quality")
    return table(spark, folder, "labels", "doc_id", "quality").select(
        "doc_id", F.when(quality == 1, "true").when(quality == 0, "fake").alias("label")
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows ``(doc_id, text, source, label)``; both sides are keyed by document."""
    return documents(spark, folder).join(labels(spark, folder), "doc_id")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Publication instants ``(doc_id, ts)`` taken from the event of the same number."""
    return table(spark, folder, "events", "event_id", "ts").select(F.col("event_id").alias("doc_id"), "ts")
