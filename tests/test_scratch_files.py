"""Finished steps leave no shuffle files, and few pairs do not make the vectors travel."""

import os

from pyspark.sql import functions as F

from textsieve.operators import tfidf as tf
from textsieve.session import swept


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_of_finished_steps_are_deleted(spark):
    swept(spark)
    before = shuffle_files(spark)
    out = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    assert len(out.collect()) == 10 and shuffle_files(spark) - before
    del out
    swept(spark)
    assert not shuffle_files(spark) - before


def test_terms_of_one_row_do_not_meet(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "alone")], "id long, term string")
    later = rows.withColumnRenamed("id", "_other")
    met = {(r.id, r._other) for r in tf.meet(rows, later, ["term"], "id", "_other", least=2).collect()}
    assert met == {(i, j) for i in (1, 2) for j in (1, 2)}


def test_word_contributions_leave_one_table(spark, folder):
    """Weights are written before words meet them; counts, vocabulary and the shuffles behind them are gone by then."""
    from textsieve.plans.catalog import model_queries as mq
    from textsieve.session import shared_dir

    tables = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("written-")}
    swept(spark)
    had, files = tables(), shuffle_files(spark)
    shown = mq.word_contributions(spark, folder)
    assert len(tables() - had) == 1 and not shuffle_files(spark) - files
    assert shown.count() > 0
