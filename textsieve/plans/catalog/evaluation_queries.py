"""Metrics over predictions of a length rule on the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import metrics as me
from ...operators import results
from ...sources.tables import labelled
from . import sql_parts as q
from .registry import query
from .text_queries import _KINDS, quoted_documents

_SCORED = f"""{q.CORPUS}, scored AS (SELECT doc_id, source, label, text, round(ln(1 + length(text)) - 7, 9) AS score FROM corpus),
    preds AS (SELECT *, CASE WHEN score >= 0 THEN 'true' ELSE 'fake' END AS predicted FROM scored)"""


def cells(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    parts = ", ".join(
        f"count(*) FILTER (label = '{a}' AND predicted = '{b}')::BIGINT AS {a}_as_{b}" for a in ("fake", "true") for b in ("fake", "true")
    )
    return f"cells AS (SELECT {lead}{parts} FROM preds{tail})"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END"


RECALL_FAKE = ratio("fake_as_fake", "fake_as_fake + fake_as_true")
RECALL_TRUE = ratio("true_as_true", "true_as_true + true_as_fake")
F1 = (
    f"({ratio('2 * fake_as_fake', '(2 * fake_as_fake + fake_as_true + true_as_fake)')} + "
    f"{ratio('2 * true_as_true', '(2 * true_as_true + fake_as_true + true_as_fake)')}) / 2"
)
PRESENT = "((fake_as_fake + fake_as_true > 0)::INTEGER + (true_as_true + true_as_fake > 0)::INTEGER)"
METRICS = f"""(fake_as_fake + fake_as_true + true_as_fake + true_as_true)::BIGINT AS n,
    round(100 * (fake_as_fake + true_as_true) / (fake_as_fake + fake_as_true + true_as_fake + true_as_true)::DOUBLE, 6) AS accuracy,
    round(100 * {F1}, 6) AS f1_macro, round(100 * ({RECALL_FAKE} + {RECALL_TRUE}) / {PRESENT}, 6) AS bal_acc,
    round(100 * {RECALL_FAKE}, 6) AS recall_fake, round(100 * {RECALL_TRUE}, 6) AS recall_true"""
CELL_LIST = "fake_as_fake, fake_as_true, true_as_fake, true_as_true"
RATES = ["accuracy", "f1_macro", "bal_acc", "recall_fake", "recall_true"]


def predictions(spark, d):
    rows = labelled(spark, d).withColumn("score", F.round(tx.log_chars("text") - 7, 9))
    return rows.withColumn("predicted", tx.score_to_label("score"))


def rounded(df, names=RATES):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("confusion_by_source", "E1", f"WITH {_SCORED}, {cells('source')} SELECT source, {CELL_LIST} FROM cells")
def confusion_by_source(spark, d):
    return me.confusion(predictions(spark, d), ["source"])


@query("metrics_overall", "E2 E3 E4 E5 E13", f"WITH {_SCORED}, {cells()} SELECT {CELL_LIST}, {METRICS} FROM cells")
def metrics_overall(spark, d):
    return rounded(me.evaluate(predictions(spark, d), []))


@query(
    "metrics_by_source",
    "E2 E3 E4 E5",
    f"WITH {_SCORED}, {cells('source')} SELECT source, {CELL_LIST}, {METRICS} FROM cells",
)
def metrics_by_source(spark, d):
    return rounded(me.evaluate(predictions(spark, d), ["source"]))


@query(
    "metrics_with_overall",
    "A15",
    f"""WITH {_SCORED}, {cells('source')}, r AS (SELECT coalesce(source, 'all') AS source, {', '.join(f'sum({c})::BIGINT AS {c}' for c in me.CELLS)}
        FROM cells GROUP BY ROLLUP (source)) SELECT source, {CELL_LIST}, {METRICS} FROM r""",
)
def metrics_with_overall(spark, d):
    return rounded(me.with_overall(predictions(spark, d), "source", "all"))


@query(
    "accuracy_by_source",
    "E6",
    f"""WITH {_SCORED} SELECT label, source, round(100 * avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
        count(*)::BIGINT AS n FROM preds GROUP BY ALL""",
)
def accuracy_by_source(spark, d):
    return rounded(me.source_accuracy(predictions(spark, d), ["label"], "source"))


_WILSON = """round(100 * ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS acc_low,
    round(100 * ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS acc_high"""


@query(
    "wilson_by_source",
    "E7",
    f"""WITH {_SCORED}, {cells('source')}, w AS (SELECT source, (fake_as_fake + true_as_true)::DOUBLE / n AS p, n::DOUBLE AS n FROM
        (SELECT *, fake_as_fake + fake_as_true + true_as_fake + true_as_true AS n FROM cells)) SELECT source, {_WILSON} FROM w""",
)
def wilson_by_source(spark, d):
    full = me.with_wilson(me.evaluate(predictions(spark, d), ["source"]))
    return rounded(full.select("source", "acc_low", "acc_high"), ["acc_low", "acc_high"])


@query("bootstrap_intervals", "E8 E14")
def bootstrap_intervals(spark, d):
    return me.full_metrics(predictions(spark, d), ["source"])


@query(
    "auc_of_score",
    "E9 W9",
    f"""WITH {_SCORED}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM preds),
        s AS (SELECT count(*) FILTER (label = 'true')::DOUBLE AS p, count(*) FILTER (label = 'fake')::DOUBLE AS n,
              sum(rk) FILTER (label = 'true') AS r FROM k)
        SELECT round((r - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""",
)
def auc_of_score(spark, d):
    return me.auc(predictions(spark, d), [], "score", F.col("label") == "true").withColumn("auc", F.round("auc", 6))


@query(
    "two_population_recall",
    "E10",
    f"""WITH {_KINDS}, p AS (SELECT kind, CASE WHEN ln(1 + length(t)) - 7 >= 0 THEN 'true' ELSE 'fake' END AS predicted FROM kinds),
        r AS (SELECT avg(CASE WHEN predicted = 'true' THEN 100.0 ELSE 0 END) FILTER (kind = 'true_resumida') AS rt,
              avg(CASE WHEN predicted = 'fake' THEN 100.0 ELSE 0 END) FILTER (kind = 'fake_texto_checagem') AS rf FROM p)
        SELECT round(rt, 6) AS recall_true, round(rf, 6) AS recall_fake, round((rt + rf) / 2, 6) AS bal_acc FROM r""",
)
def two_population_recall(spark, d):
    rows = quoted_documents(spark, d).select("kind", tx.score_to_label(tx.log_chars("t") - 7).alias("predicted"))
    both = me.two_population_recall(rows, F.col("kind") == "true_resumida", F.col("kind") == "fake_texto_checagem")
    return rounded(both)


@query(
    "prediction_errors",
    "E12",
    f"WITH {_SCORED} SELECT doc_id, source, label, predicted, {q.first_words('text', 50)} AS short_text FROM preds WHERE label <> predicted",
)
def prediction_errors(spark, d):
    wrong = me.errors(predictions(spark, d))
    return wrong.select("doc_id", "source", "label", "predicted", tx.first_words("text", 50).alias("short_text"))


@query(
    "standardized_hybrid",
    "M10",
    f"""WITH {_SCORED}, s AS (SELECT doc_id, label, score AS a, {q.word_count('text')}::DOUBLE AS b FROM preds),
        z AS (SELECT doc_id, label, (a - (SELECT avg(a) FROM s)) / (SELECT stddev_pop(a) FROM s) AS a,
              (b - (SELECT avg(b) FROM s)) / (SELECT stddev_pop(b) FROM s) AS b FROM s)
        SELECT doc_id, round(0.5 * a + 0.5 * b, 6) AS score, CASE WHEN round(0.5 * a + 0.5 * b, 6) >= 0 THEN 'true' ELSE 'fake' END AS predicted FROM z""",
)
def standardized_hybrid(spark, d):
    from ...models.blend import blend_scores

    rows = predictions(spark, d).select(
        "doc_id", F.col("score").alias("a"), tx.word_count("text").cast("double").alias("b")
    )
    mixed = blend_scores(rows, ["a", "b"]).withColumn("score", F.round("score", 6))
    return mixed.select("doc_id", "score", tx.score_to_label("score").alias("predicted"))


@query("report_payload", "S11")
def report_payload(spark, d):
    rows = predictions(spark, d)
    by_source = rounded(me.evaluate(rows, ["source"]))
    return results.report_payload(sources=by_source, overall=rounded(me.evaluate(rows, [])))
