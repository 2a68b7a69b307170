"""Corpus preparation: minimum words, first copy only, decontamination, split, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import word_tokens
from ..functions.text import word_count
from ..operators.groups import minimum_words
from ..operators.ranking import keep_first
from ..operators.splits import split_by_class
from ..operators.tfidf import decontaminate, near_copies
from ..session import cut_lineage

# Least number of words per class and the similarity that counts as a copy.
MINIMA = {"fake": 20}
OTHER_MINIMUM = 30
COPY_THRESHOLD = 0.8


def prepare(rows: DataFrame, tests: DataFrame, identity: str, test_id: str) -> DataFrame:
    """``rows(id, text, label, source, ts)`` cleaned against ``tests(test_id, text)`` with a split column.

    Deduplicated rows are written once, since they are read for frequencies, candidates and
    vectors. After the copies are known only narrow columns travel on to the split.
    """
    long_enough = rows.where(minimum_words(word_count("text"), F.col("label"), MINIMA, OTHER_MINIMUM))
    firsts = cut_lineage(keep_first(long_enough, F.col("text"), identity))
    toks = word_tokens("text")
    copies = near_copies(
        firsts.select(identity, "text"), tests, identity, test_id, toks, toks, COPY_THRESHOLD
    )
    clean = cut_lineage(decontaminate(firsts.select(identity, "label", "source", "ts"), copies, identity))
    return split_by_class(clean, "source", "label", "ts", identity)


def summary(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("split", "label", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
    )
