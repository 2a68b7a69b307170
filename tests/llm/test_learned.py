"""Quality classifier and language identification: held-out accuracy, whole texts, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import LONG
from pyspark.sql import functions as F

from textsieve.llm import language_id, quality_model
from textsieve.llm.queries import op4_quality_classifier, op8_language_id
from textsieve.llm.words import words

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    scored = op4_quality_classifier(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_scores_equal_the_mean_of_vectors(spark, odd, empty):
    rng = np.random.default_rng(0)
    settings = quality_model.Settings(buckets=1 << 10, dimensions=4)
    model = quality_model.Model(settings, rng.normal(size=(1 << 10, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), np.array([0.1, 0.4]))
    got = {(r["doc_id"], r["row"]): r["score"] for r in quality_model.score(odd, model, keep=("doc_id", "row")).collect()}
    for r in odd.collect():
        ids = np.concatenate([quality_model.gram_ids(w, settings)[1] for w in words(pa.array([r["text"]]))])
        mean = model.vectors[ids].astype(float).mean(axis=0) if len(ids) else np.zeros(4)
        logits = mean @ model.outputs + model.biases
        assert got[(r["doc_id"], r["row"])] == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-6)
    assert quality_model.score(empty, model).count() == 0


def test_grams_do_not_cross_rows():
    settings = quality_model.Settings()
    texts = ["one two two", "", "é日本 x", "z", "one two two"]
    alone = [np.concatenate([quality_model.gram_ids(w, settings)[1] for w in words(pa.array([t]))]) for t in texts]
    for found in words(pa.array(texts)):
        counts, flat = quality_model.gram_ids(found, settings)
        ends = np.cumsum(counts)
        for end, n, want in zip(ends, counts, alone, strict=True):
            assert sorted(flat[end - n : end]) == sorted(want)


def test_fit_without_labels_or_with_one_class(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.score(odd, quality_model.fit(odd, labels)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, None), (8, 3), (None, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in quality_model.score(odd, quality_model.fit(odd, labels)).collect())


def test_language_held_out(spark):
    found = op8_language_id(spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where(F.col("held_out") & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd, empty):
    rng = random.Random(0)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ve", "ry"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(4)) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "kalomi", None)]
    dictionaries = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(dictionaries) == ["aa", "bb"]
    got = {r["row"]: r for r in language_id.predict(odd, dictionaries, keep=("row",)).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (None, 3, 4))
    assert got[7]["lang_pred"] in ("aa", "bb")
    mine = spark.createDataFrame([(1, "kalomika milokalo mikalolo kamikalo"), (2, "zuvery ryvezuzu veryzuve zuzuryve"), (3, "12 34")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(mine, dictionaries).orderBy("doc_id").collect()] == ["aa", "bb", "und"]
    assert language_id.predict(empty, dictionaries).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.learn(empty)).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    same = {"aa": b"kalomi " * 200, "bb": b"kalomi " * 200}
    row = language_id.predict(spark.createDataFrame([(1, "kalomi kalo")], "doc_id long, text string"), same).first()
    assert row["lang_pred"] == "aa" and row["rejected"] and row["score"] == 0.5


def test_every_block_of_a_long_text_counts():
    names, tools = language_id._compressors({"aa": b"kalomi", "bb": b"zuvery"})
    raw = LONG.encode()
    whole = language_id.sizes(raw, tools)
    parts = sum(language_id.sizes(raw[i : i + language_id.BLOCK], tools) for i in range(0, len(raw), language_id.BLOCK))
    assert whole.tolist() == parts.tolist() and names == ["aa", "bb"]


def test_dictionaries_learn_from_whole_distinct_texts(spark):
    """A shared header longer than a slice, and copies of one text, do not crowd out the language's own prose."""
    header = "menu licence header " * 100
    rows = [(i, header + " ".join(f"prose{i}x{k}" for k in range(400)), "aa") for i in range(20)]
    rows += [(100 + i, "copied text of many rows", "aa") for i in range(400)]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["aa"].decode("utf-8", "replace")
    assert learned.count("copied text") == 1
    assert sum(f"prose{i}x" in learned for i in range(20)) == 20
    short = language_id.learn(spark.createDataFrame(rows[:1] + [(1, "Short Text", "bb")], "doc_id long, text string, lang string"))
    assert short["bb"] == b"\nshort text"


def test_classifier_learns_from_all_grams(spark, monkeypatch):
    """Every gram of a long text reaches training, as counts."""
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda rows, settings: seen.extend(rows))
    docs = spark.createDataFrame([(1, LONG), (2, "two words")], "doc_id long, text string")
    quality_model.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    settings = quality_model.Settings()
    for text, label in ((LONG, 1), ("two words", 0)):
        ids = np.concatenate([quality_model.gram_ids(w, settings)[1] for w in words(pa.array([text]))])
        want, times = np.unique(ids, return_counts=True)
        assert [(i.tolist(), c.tolist()) for i, c, y in seen if y == label] == [(want.tolist(), times.tolist())]


def test_sample_reaches_the_driver_packed(spark, monkeypatch):
    """What the driver gets of the sample is far less than two numbers of four bytes a gram, and opens to the same rows."""
    got, seen = [], []
    docs = spark.createDataFrame([(i, " ".join(f"word{i * k % 997}" for k in range(3000))) for i in range(40)], "doc_id long, text string")
    arrow = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: got.append(arrow(df)) or got[-1])
    monkeypatch.setattr(quality_model, "train", lambda rows, settings: seen.extend(rows))
    quality_model.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    grams = sum(len(ids) for ids, _, _ in seen)
    assert len(seen) == 40 and grams > 40_000
    assert 0 < sum(t.nbytes for t in got) < 8 * grams / 2
