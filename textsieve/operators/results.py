"""Results log, write-once results, content-keyed cache and report payload."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_to_map(columns: Sequence[str]) -> Column:
    """Non-null columns of a row as ``map<name, value>``."""
    columns = list(columns)
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def append_result(metrics: DataFrame, path: str) -> None:
    """Append metric rows. Long rows never change the columns of the log, so nothing is rewritten."""
    metrics.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a final result; refuses when one exists."""
    df.write.mode("errorifexists").parquet(path)


def content_key(model: str, prefix: str, text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.concat_ws("\x1f", F.lit(model), F.lit(prefix), text))


def missing_from_cache(texts: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row per key that the cache does not hold yet."""
    return texts.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything, in any store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def fill_cache(
    spark: SparkSession, texts: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "key"
) -> DataFrame:
    """Compute and append only what is absent, then return the cached rows of ``texts`` and no others."""
    schema = compute(texts.limit(0)).schema
    if table_exists(spark, path):
        missing = missing_from_cache(texts, spark.read.schema(schema).parquet(path), key)
    else:
        missing = texts.dropDuplicates([key])
    compute(missing).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(texts.select(key).distinct(), key, "left_semi")


def report_payload(**sections: DataFrame) -> DataFrame:
    """One JSON document with a list of records per section.

    Report tables are summaries; the list is built from their few rows, nulls are kept out.
    """
    out = None
    for name, rows in sections.items():
        part = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("json"))
        part = part.select(F.lit(name).alias("section"), "json")
        out = part if out is None else out.unionByName(part)
    body = F.concat_ws(",", F.sort_array(F.collect_list(F.concat(F.lit('"'), "section", F.lit('":'), "json"))))
    return out.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("payload"))
