"""Vocabularies of folds by subtraction against one count per training side."""

import pytest
from pyspark.sql import functions as F
from test_operators import make_texts

from textsieve.functions.ngrams import word_ngrams
from textsieve.models import protocols as pr
from textsieve.models import specs as sp
from textsieve.models import training as tr
from textsieve.operators import folds as fd
from textsieve.operators import tfidf as tf


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    texts = make_texts(60, 4)
    data = [(i, t, None if i == 59 else i % 3, "fake" if i % 2 else "true") for i, t in texts.items()]
    return spark.createDataFrame(data, "id long, text string, fold int, label string")


@pytest.mark.parametrize(("most", "min_df"), [(None, 1), (25, 2)])
def test_sides_equal_a_count_of_each(spark, rows, most, min_df):
    grams = word_ngrams("text", 1, 2)
    got, sizes = fd.fold_vocabularies(rows, "fold", grams, most, min_df)
    got = got.select("fold", "term", "df", "total", F.round("idf", 9)).collect()
    for fold in range(3):
        side = rows.where(F.coalesce(F.col("fold") != fold, F.lit(True)))
        assert sizes[fold] == side.count()
        terms = tf.with_idf(tf.vocabulary(tf.term_counts(side, "id", grams), most, min_df), tf.row_total(side))
        want = rows_of(terms.select(F.lit(fold), "term", "df", "total", F.round("idf", 9)))
        assert sorted(tuple(r) for r in got if r["fold"] == fold) == want


def test_texts_are_read_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    held = fd.held_counts(rows.withColumn("text", watched.asNondeterministic()("text")), "fold", word_ngrams("text", 1, 2)).collect()
    assert held and seen.value == rows.count()
    empty, sizes = fd.fold_vocabularies(rows.limit(0), "fold", word_ngrams("text", 1, 2))
    assert empty.count() == 0 and sizes == {}


def test_scores_equal_models_fitted_alone(spark, rows):
    known = rows.where("fold IS NOT NULL")
    spec = sp.Spec((sp.TextBlock(max_features=60),), classifier="logreg", balanced=False)
    got = {r["id"]: r["score"] for r in pr.out_of_fold(known, spec, "id", 3).collect()}
    for fold in range(3):
        model = tr.train(known.where(F.col("fold") != fold), spec, mixed=False)
        for r in tr.score(model, known.where(F.col("fold") == fold), words=None).collect():
            assert got[r["id"]] == pytest.approx(r["score"], abs=1e-3)
