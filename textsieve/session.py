"""Session helpers: local sessions for tests, lineage cutting and fan-out of small files."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_DIRS: dict[str, str] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "textsieve") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TEXTSIEVE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        # the setting is fixed once a session runs, so the folder is remembered here
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="textsieve-ckpt-")
        return _OWN_DIRS[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Parquet in the shared folder, read back: compressed, by column, and of a size Spark knows when it picks joins.

    For large tables whose partitions need not stay as they are; ``cut_lineage`` keeps those.
    """
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing will read again."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(conf).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Free the disk of finished steps: Spark deletes shuffle files once nobody refers to their plans, which takes a collection."""
    # Python's handles of finished frames go first, then what they held in the JVM
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` when the scan has fewer splits than the cluster has cores.

    A large table already has more splits than cores and passes through untouched, so no
    shuffle is added where it would cost; a small single-row-group file is fanned out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, key) if splits <= cores else df
