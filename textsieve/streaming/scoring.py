"""Scoring a stream of lines with a saved model; the same code as for a table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import certainty_band, first_words, score_to_label, short_input, strip, word_count
from ..models.training import PRODUCT_WORDS


def read_line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new files in a folder, without blank and ``#`` lines."""
    lines = spark.readStream.text(folder)
    return lines.where((strip("value") != "") & ~F.col("value").startswith("#")).withColumnRenamed("value", "text")


def score_stream(model: PipelineModel, lines: DataFrame) -> DataFrame:
    """Class, score, certainty and short-input notice per line; stateless, so any sink mode works."""
    cut = lines.withColumn("text", first_words("text", PRODUCT_WORDS))
    scored = model.transform(cut).select("text", vector_to_array("rawPrediction")[1].alias("score"))
    return scored.select(
        "text", "score", score_to_label("score").alias("predicted"), certainty_band("score").alias("certainty"),
        short_input(word_count("text")).alias("short_input"),
    )
