"""Reading tables and keeping intermediate results for the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; a table without one of them gets it as null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder that all executors share and read it back.

    The result does not depend on executors that held shuffle files, and its size is known to Spark's
    join selection. Lineage ends here, so finished steps can be cleaned up (``release``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textsieve-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of finished steps.

    Kept ``tables`` that nothing will read again are deleted. The driver is asked to collect garbage: Spark then
    deletes shuffle files of steps nobody refers to.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(conf).delete(path, True)
    # Python's handles of finished frames go first, then what they held in the JVM
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.2)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside, for rows that hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add; compares as Spark does, without case."""
    lower = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lower])


def crc_class(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % modulus
