"""The studies run over all their training sets and methods."""

import pytest

from textsieve.models import protocols as pr
from textsieve.models import specs as sp
from textsieve.plans.catalog import model_queries as mq

QUICK = sp.Spec((sp.Numbers("pct"),), classifier="logreg", max_iter=3)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(24):
        fake = i % 2 == 0
        words = "urgente compartilhe isso agora" if fake else "segundo o instituto em 2026 foram 35 casos"
        data.append((i, f"{words} item{i % 5}", "fake" if fake else "true", "t1", [float(fake), 1.0] if i % 3 else None))
    return spark.createDataFrame(data, "doc_id long, text string, label string, test string, embedding array<float>").persist()


def test_data_study_runs_every_combination(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(pr, "data_study", lambda corpora, test, combos, spec: asked.append((corpora, combos)))
    mq.data_combinations(spark, folder)
    corpora, combos = asked[0]
    assert len(set(combos)) == 17 and sum("x" in c for c in combos) == 6
    found = {r.corpus for r in corpora.select("corpus").distinct().collect()}
    assert found == {"docs", "open", "talk", "bench"}


def test_a_training_set_of_one_class_predicts_it(spark, rows):
    corpora = rows.select("text", "label").selectExpr("'docs' AS corpus", "*").unionByName(
        rows.where("label = 'true'").selectExpr("'bench' AS corpus", "text", "label")
    )
    got = {r.experiment: r for r in pr.data_study(corpora, rows, ["docs", "bench", "docs+benchx3"], QUICK).collect()}
    assert set(got) == {"docs", "bench", "docs+benchx3"} and all(r.n == 24 for r in got.values())
    assert got["bench"].true_as_true == 12 and got["bench"].fake_as_true == 12


def test_all_eight_methods_are_frozen_and_evaluated(spark, folder, rows, monkeypatch, tmp_path):
    asked = []
    monkeypatch.setattr(pr, "freeze", lambda train, methods, folder, own: asked.append((train, methods, own)))
    monkeypatch.setattr(pr, "evaluate_frozen", lambda tests, names, folder: [(tests, names)])
    tests, names = mq.freeze_then_evaluate(spark, folder)
    train, methods, own = asked[0]
    assert len(names) == 8 and names == list(methods) and set(own) == set(sp.EARLIER)
    assert "embedding" in train.columns and tests.where("embedding IS NULL").count() == 0
    monkeypatch.undo()
    few = {"saved": QUICK, "embeddings": sp.Spec((sp.Embedding(),), classifier="logreg", max_iter=3), "numbers": QUICK}
    saved = pr.freeze(rows, few, str(tmp_path), {"saved": rows.select("text", "label")})
    assert len(saved) == 3
    filled = rows.selectExpr("doc_id", "text", "label", "test", "coalesce(embedding, array(0f, 0f)) AS embedding")
    measured, predictions = pr.evaluate_frozen(filled, list(few), str(tmp_path))
    assert {(r.method, r.test, r.n) for r in measured.collect()} == {(m, t, 24) for m in few for t in ("t1", "all")}
    assert predictions.count() == 72
