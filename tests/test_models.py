"""Model invariants on a small separable corpus."""

import math

import pytest
from pyspark.sql import functions as F

from textsieve.models import protocols as pr
from textsieve.models import specs as sp
from textsieve.models import training as tr


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(40):
        fake = i % 2 == 0
        words = ("urgente compartilhe isso agora" if fake else "segundo o instituto em 2026 foram 35 casos")
        data.append((i, i // 2, f"{words} palavra{i % 7} item{i % 5}", "fake" if fake else "true", f"s{i % 4}"))
    return spark.createDataFrame(data, "id long, pair long, text string, label string, source string").persist()


@pytest.fixture(scope="module")
def chosen(rows):
    return tr.train(rows, sp.CHOSEN)


def test_scores_are_finite_and_complete(rows, chosen):
    got = tr.score(chosen, rows).collect()
    assert len(got) == 40 and all(math.isfinite(r.score) for r in got)
    assert sum(r.label == r.predicted for r in got) >= 38
    assert all((r.score >= 0) == (r.predicted == "true") for r in got)


def test_explanation_sums_to_score(rows, chosen):
    parts = tr.explain(chosen, rows, "id").groupBy("id").agg(F.sum("contribution").alias("c"))
    gap = parts.join(tr.score(chosen, rows), "id").agg(
        F.max(F.abs(F.col("c") + chosen.stages[-1].intercept - F.col("score"))), F.count(F.lit(1))
    )
    worst, n = gap.collect()[0]
    assert n == 40 and worst < 1e-6


def test_save_and_load(rows, chosen, tmp_path):
    tr.save(chosen, str(tmp_path), ["x", "chosen"], "chosen")
    again = tr.load(str(tmp_path), ["x", "chosen"], "chosen")
    a = {r.id: r.score for r in tr.score(chosen, rows).collect()}
    b = {r.id: r.score for r in tr.score(again, rows).collect()}
    assert a == b
    assert tr.describe(again)["analyzer"] == "char_wb"


def test_fit_ignores_validation_text(rows):
    first = tr.train(rows.where("id < 30"), sp.BASE)
    second = tr.train(rows.where("id < 30"), sp.BASE)
    changed = rows.where("id >= 30").withColumn("text", F.lit("outra coisa"))
    tr.score(first, changed).count()
    assert sorted(tr._text_parts(first)[1]) == sorted(tr._text_parts(second)[1])


def test_number_block_round_trip(rows, tmp_path):
    model = tr.train(rows, sp.Spec((sp.TextBlock(), sp.Numbers("categories", 0.3)), max_iter=5))
    path = str(tmp_path / "m")
    model.write().save(path)
    again = type(model).load(path)
    assert tr.score(again, rows).count() == 40


def test_out_of_fold_covers_every_row_once(rows):
    folded = pr.with_folds(rows, "pair", "label", 2)
    got = pr.out_of_fold(folded, sp.Spec((sp.Numbers("pct"),), classifier="logreg", max_iter=5), "id", 2)
    assert got.count() == 40 and got.select("id").distinct().count() == 40


def test_grid_has_48_settings():
    assert len(sp.grid()) == 48
    assert len(sp.text_variants()) == 12 and len(sp.number_variants()) == 10


def test_stream_scores_like_a_table(spark, rows, chosen, tmp_path):
    from textsieve.streaming.scoring import read_line_stream, score_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("# nota\n\nurgente compartilhe isso agora\nsegundo o instituto em 2026\n", "utf-8")
    out = score_stream(chosen, read_line_stream(spark, str(source)))
    run = out.writeStream.format("memory").queryName("scored_lines").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.predicted for r in spark.table("scored_lines").collect()} == {"fake", "true"}


def test_shared_features_give_the_models_of_single_fits(rows):
    """Models that share one feature table score like models fitted alone, also when scored side by side."""
    specs = {"one": sp.PLAIN, "ten": sp.Spec(c=10.0, balanced=False), "logistic": sp.Spec(classifier="logreg", balanced=False)}
    models = pr.train_all(rows, specs)
    assert len({tuple(s.uid for s in m.stages[:-1]) for m in models.values()}) == 1
    together = {(r.id, r.method): r.score for r in tr.score_many(models, rows).collect()}
    assert len(together) == 120
    for name, spec in specs.items():
        alone = tr.score(tr.train(rows, spec), rows).collect()
        assert all(abs(together[r.id, name] - r.score) < 1e-6 for r in alone)


def test_grid_on_unseen_sources(rows):
    """No source on both sides; sizes counted ahead equal those of the fitted models; means over settings."""
    train_rows, test_rows = pr.unseen_sources(rows)
    seen, held = ({r.source for r in side.select("source").distinct().collect()} for side in (train_rows, test_rows))
    assert seen and held and not seen & held and seen | held == {f"s{i}" for i in range(4)}
    settings = [s for s in sp.grid() if s[0] in ("word (1,1)", "char_wb (3,5)") and not s[1].sublinear and s[2] != 10.0]
    measured = pr.grid_search(train_rows, test_rows, settings)
    got = {(r.repr, r.c, r.min_df, r.sublinear): r for r in measured.collect()}
    sizes = {(r.repr, r.c, r.min_df, r.sublinear): r.n_features for r in pr.grid_sizes(train_rows, settings).collect()}
    assert len(got) == 8 and {k: r.n_features for k, r in got.items()} == sizes
    found = {(r.setting, r.value): r for r in pr.by_setting(measured).collect()}
    ones = [r.bal_acc for k, r in got.items() if k[1] == 1.0]
    assert found["c", "1.0"].n == 4 and found["c", "1.0"].best == max(ones)
    assert math.isclose(found["c", "1.0"].mean, sum(ones) / 4)


def test_fits_side_by_side_share_no_cache(spark, rows):
    """Equal plans share one cache entry: a fit that drops it takes the blocks from under the others."""
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keys())
    dropped = []
    unpersist = type(rows).unpersist
    type(rows).unpersist = lambda df, *a: dropped.append(df) or unpersist(df, *a)
    try:
        numbers = sp.Numbers("pct")
        models = pr.train_all(rows, {"a": sp.Spec(max_iter=3), "b": sp.Spec((sp.WORDS, numbers), max_iter=3), "c": sp.Spec((numbers,), max_iter=3)})
    finally:
        type(rows).unpersist = unpersist
    assert len(models) == 3 and not dropped
    assert kept >= set(spark.sparkContext._jsc.getPersistentRDDs().keys())


def test_learning_tables_are_even_and_bare(rows):
    """Partitions are bounded by the cores, and no cell's name travels with the vectors."""
    many = rows.repartition(400)
    texts = tr.learning_texts(many)
    assert texts.rdd.getNumPartitions() == 1 and texts.count() == 120
    spec = sp.Spec((sp.WORDS, sp.Numbers("pct")), max_iter=3)
    _, table, total = tr.learned_features(texts, spec)
    assert table.schema["features"].metadata == {} and total == 120


def test_blocks_that_differ_in_damping_share_a_vocabulary(rows):
    from dataclasses import replace

    specs = [sp.BASE, sp.Spec((replace(sp.WORDS, sublinear=True), sp.Numbers("pct")))]
    plain, damped = tr.shared_stages(tr.learning_texts(rows), specs)
    one, two = plain[1].stages[0], damped[1].stages[0]
    assert one.vocabulary == two.vocabulary and len(damped[1].stages) == len(plain[1].stages) + 1
    assert (one.getOutputCol(), two.getOutputCol()) == ("features_counts", "block0_counts")
