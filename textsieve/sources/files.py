"""File sources and sinks: quoted CSV, split parquet, line files with captions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.ranking import carry_forward
from ..session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header, quoted fields over several lines, doubled quotes; a byte-order mark is skipped."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', quoteAll=True, encoding="UTF-8", emptyValue="")


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """Parquet partitioned by split, so that reading one part prunes the others."""
    df.write.partitionBy(column).parquet(path)


def read_split(spark: SparkSession, path: str, part: str, column: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(column) == part).drop(column)


def union_of_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str, keep_comments: bool = False) -> DataFrame:
    """One text per line, without blank lines and, by default, without ``#`` lines."""
    lines = spark.read.text(path).where(strip("value") != "")
    return lines if keep_comments else lines.where(~F.col("value").startswith("#"))


def captioned(lines: DataFrame, position: str = "line_no", file: str = "file") -> DataFrame:
    """``(file, position, caption, text)``: a ``#`` line describes the text lines after it."""
    bare = lines.withColumn("value", strip("value"))
    head = F.when(F.col("value").startswith("#"), F.regexp_replace("value", "^[# ]+", ""))
    filled = carry_forward(bare.withColumn("_head", head), [file], position, "_head", "caption")
    texts = filled.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return texts.select(file, position, "caption", F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a position that increases along the file.

    Splits of a file start at least a megabyte apart; inside a split lines keep their order.
    """
    megabyte = F.floor(F.col("_metadata.file_block_start") / 2**20)
    inside = F.monotonically_increasing_id() % F.lit(2**33)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (megabyte * F.lit(2**33) + inside).alias("line_no"), "value"
    )
