"""Fitting, scoring, saving and inspecting linear text models on MLlib."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_words, score_to_label
from ..operators import tfidf as tf
from ..operators.explain import word_contributions
from ..operators.folds import fold_vocabularies
from ..operators.groups import cut_lengths
from ..session import cut_lineage
from .specs import Spec, TextBlock
from .stages import MAX_WIDTH, GramTokenizer, TfidfEstimator

PRODUCT_WORDS = 50
MIXED_LENGTHS = (30, 50, 100)
PARALLEL_FITS = 8


def in_parallel(jobs: Iterable[Callable[[], object]], width: int = PARALLEL_FITS) -> list:
    """Independent fits submitted together; each one is itself a distributed job."""
    jobs = list(jobs)
    session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    run = inheritable_thread_target(session)(lambda job: job())
    with ThreadPool(min(width, max(len(jobs), 1))) as pool:
        return pool.map(run, jobs)


def prepared(rows: DataFrame, balanced: bool, label: str = "label") -> tuple[DataFrame, float]:
    """Numeric target (true is positive), class weight, and the sum of weights."""
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {"fake", "true"}:
        raise ValueError(f"training needs rows of both classes, got {sorted(map(str, sizes))}")
    n = sum(sizes.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col(label) == "fake", n / (2.0 * sizes["fake"])).otherwise(n / (2.0 * sizes["true"]))
    target = F.when(F.col(label) == "true", 1.0).otherwise(0.0)
    return rows.withColumns({"_y": target, "_w": weight}), float(n)


def classifier(spec: Spec, total_weight: float):
    """The penalty C of a summed loss equals ``1 / (C x weights)`` on a mean loss."""
    common = dict(
        featuresCol="features", labelCol="_y", weightCol="_w", maxIter=spec.max_iter, tol=1e-4,
        regParam=1.0 / (spec.c * total_weight), standardization=False,
    )
    return LogisticRegression(**common) if spec.classifier == "logreg" else LinearSVC(**common)


#: Characters of text (and 8 for a value of an embedding) in a partition of learning texts.
CHARS_PER_PARTITION = 2_000_000


def learning_texts(
    rows: DataFrame, mixed: bool = True, text: str = "text", label: str = "label", carry: Sequence[str] = ()
) -> DataFrame:
    """Texts that a model learns from, with the columns ``carry``, written once to the shared folder in even partitions.

    Every step of a solver shuffles one dense gradient per partition, so their number follows the size of the texts
    only up to twice the cores: what a step shuffles does not grow with the rows beyond that.
    """
    used = rows.select(*[c for c in rows.columns if c in {text, label, "embedding", *carry}])
    used = cut_lineage(cut_lengths(used, text, MIXED_LENGTHS) if mixed else used)
    cells = 8 * F.size("embedding") if "embedding" in used.columns else F.lit(0)
    held = used.agg(F.sum(F.coalesce(F.length(text) + cells, F.lit(0)))).first()[0] or 0
    most = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(used.repartition(max(1, min(most, -(-held // CHARS_PER_PARTITION)))))


def shared_stages(texts: DataFrame, specs: Sequence[Spec], text: str = "text") -> list[list]:
    """Feature stages of every spec, TF-IDF blocks fitted already: one vocabulary for all blocks that differ in damping only."""
    made = [spec.stages(text) for spec in specs]
    places: dict[TextBlock, list[tuple[int, int]]] = {}
    for i, spec in enumerate(specs):
        at = 0
        for block in spec.blocks:
            if isinstance(block, TextBlock):
                places.setdefault(replace(block, sublinear=False), []).append((i, at + 1))
            at += len(block.stages(text, "_"))

    def one(block: TextBlock):
        grams, tfidf = block.stages(text, "_shared")
        return tfidf.learned(grams.transform(texts))

    for at, found in zip(places.values(), in_parallel(lambda b=b: one(b) for b in places)):
        for i, k in at:
            made[i][k] = made[i][k].staged(*found)
    return made


def learned_features(
    texts: DataFrame, spec: Spec, text: str = "text", label: str = "label", stages: list | None = None, written: bool = False
) -> tuple[PipelineModel, DataFrame, float]:
    """Fitted feature stages of ``spec``, the table its classifier learns from, and the sum of weights.

    ``texts`` come from ``learning_texts``. A solver reads the table twice and holds it in blocks of its own, so a
    single fit need not write it. With fits side by side it is better ``written``: every step of a solver sends its
    lineage to the tasks, which one thread of the driver prepares for all of them.
    """
    ready, total = prepared(texts, spec.balanced, label)
    features = Pipeline(stages=stages or spec.stages(text)).fit(ready)
    # an assembled vector carries a name for each of its cells, which every task of every step would be sent
    bare = F.col("features").alias("features", metadata={})
    table = features.transform(ready).select(bare, "_y", "_w")
    return features, cut_lineage(table) if written else table, total


def train(
    rows: DataFrame, spec: Spec, mixed: bool = True, text: str = "text", label: str = "label", stages: list | None = None
) -> PipelineModel:
    """Fit a model; ``mixed`` lets every text in three times, cut at 30, 50 and 100 words.

    ``stages`` may hold the feature stages of ``spec``, some of them fitted before.
    """
    features, learned, total = learned_features(learning_texts(rows, mixed, text, label), spec, text, label, stages)
    return PipelineModel([*features.stages, fitted(classifier(spec, total), learned)])


def fold_stages(rows: DataFrame, spec: Spec, fold: str, mixed: bool = True, text: str = "text") -> dict[int, list]:
    """Feature stages for every training side of a cross-validation, by fold; TF-IDF blocks are fitted already.

    The texts are read once for each TF-IDF block, for all folds together (``fold_vocabularies``).
    """
    used = rows.select(fold, text)
    used = cut_lengths(used, text, MIXED_LENGTHS) if mixed else used
    stages = spec.stages(text)
    known: dict[int, dict[int, PipelineModel]] = {}
    for at, stage in enumerate(stages):
        if isinstance(stage, TfidfEstimator):
            grams = next(s for s in stages if isinstance(s, GramTokenizer) and s.getOutputCol() == stage.getInputCol())
            limit = stage.getOrDefault(stage.maxFeatures) or MAX_WIDTH + 1
            terms, sizes = fold_vocabularies(grams.transform(used), fold, F.col(stage.getInputCol()), limit, stage.getOrDefault(stage.minDF))
            terms = cut_lineage(terms)
            known[at] = {f: stage.of_terms(terms.where(F.col("fold") == f), n) for f, n in sizes.items()}
    folds = {f for models in known.values() for f in models}
    return {f: [known[at][f] if at in known else stage for at, stage in enumerate(stages)] for f in folds}


def fitted(learner, rows: DataFrame):
    """Fit until the tolerance stops the solver; warns when the limit of steps did."""
    model = learner.fit(rows)
    if model.hasSummary:
        summary = model.summary() if callable(model.summary) else model.summary
        if summary.totalIterations >= learner.getMaxIter():
            warnings.warn(f"the solver stopped at its limit of {learner.getMaxIter()} steps", RuntimeWarning, stacklevel=2)
    return model


def score(model: PipelineModel, rows: DataFrame, text: str = "text", words: int | None = PRODUCT_WORDS) -> DataFrame:
    """Add ``score`` and ``predicted``; texts are read in the product format of 50 words."""
    read = rows.withColumn(text, first_words(text, words)) if words else rows
    margin = vector_to_array("rawPrediction")[1]
    return model.transform(read).select(*rows.columns, margin.alias("score")).withColumn(
        "predicted", score_to_label("score")
    )


def score_many(
    models: dict[str, PipelineModel], rows: DataFrame, text: str = "text", words: int | None = PRODUCT_WORDS
) -> DataFrame:
    """Predictions of several models side by side in long form: columns of ``rows``, score, predicted, method.

    Models that were fitted on the same feature table (``train_all``) read the rows and build the features once.
    """
    read = rows.withColumn(text, first_words(text, words)) if words else rows
    shared: dict[tuple, list[str]] = {}
    for name, model in models.items():
        shared.setdefault(tuple(stage.uid for stage in model.stages[:-1]), []).append(name)
    out = None
    for names in shared.values():
        seen = PipelineModel(models[names[0]].stages[:-1]).transform(read)
        scores = []
        for i, name in enumerate(names):
            last = models[name].stages[-1].copy()
            last.setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_predicted{i}")
            if last.hasParam("probabilityCol"):
                last.setProbabilityCol(f"_probability{i}")
            seen = last.transform(seen)
            scores.append(F.struct(vector_to_array(f"_raw{i}")[1].alias("score"), F.lit(name).alias("method")))
        part = seen.select(*rows.columns, F.explode(F.array(*scores)).alias("_s")).select(
            *rows.columns, "_s.score", score_to_label("_s.score").alias("predicted"), "_s.method"
        )
        out = part if out is None else out.unionByName(part)
    return out


def save(model: PipelineModel, folder: str, names: Sequence[str], name: str) -> str:
    """Models are filed by their number in the list of methods."""
    path = f"{folder}/{list(names).index(name):02d}"
    model.write().overwrite().save(path)
    return path


def load(folder: str, names: Sequence[str], name: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{list(names).index(name):02d}")


def _text_parts(model: PipelineModel):
    tokenizer = next(s for s in model.stages if isinstance(s, GramTokenizer))
    fitted = next(s for s in model.stages if isinstance(s, PipelineModel))
    counts = next(s for s in fitted.stages if isinstance(s, CountVectorizerModel))
    scale = next(s for s in fitted.stages if isinstance(s, ElementwiseProduct))
    return tokenizer, counts.vocabulary, scale.getScalingVec(), len(fitted.stages) == 4


def model_terms(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(term, idf, coef, df)`` of a single-block text model; its size is the model width."""
    _, vocab, idf, _ = _text_parts(model)
    coef = model.stages[-1].coefficients.toArray()
    rows = [(t, float(i), float(w), 0) for t, i, w in zip(vocab, idf, coef)]
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("idf", T.DoubleType()),
         T.StructField("coef", T.DoubleType()), T.StructField("df", T.LongType())]
    )
    return spark.createDataFrame(rows, schema)


def describe(model: PipelineModel) -> dict:
    """Parameters, vocabulary size and classes."""
    tokenizer, vocab, _, sublinear = _text_parts(model)
    last = model.stages[-1]
    return {
        "analyzer": tokenizer.getOrDefault(tokenizer.analyzer),
        "ngram_range": (tokenizer.getOrDefault(tokenizer.lo), tokenizer.getOrDefault(tokenizer.hi)),
        "lowercase": tokenizer.getOrDefault(tokenizer.lowercase),
        "sublinear_tf": sublinear,
        "vocabulary": len(vocab),
        "classifier": type(last).__name__,
        "regParam": last.getOrDefault(last.regParam),
        "classes": ["fake", "true"],
    }


def explain(model: PipelineModel, rows: DataFrame, identity: str, text: str = "text") -> DataFrame:
    """Contribution of every word to the score of a character model; they sum to score - intercept."""
    tokenizer, vocab, _, sublinear = _text_parts(model)
    lo, hi = tokenizer.getOrDefault(tokenizer.lo), tokenizer.getOrDefault(tokenizer.hi)
    read = rows.select(identity, first_words(text, PRODUCT_WORDS).alias(text))
    terms = model_terms(rows.sparkSession, model)
    grams = tokenizer.copy({tokenizer.inputCol: text, tokenizer.outputCol: "_grams"}).transform(read)
    counts = tf.term_counts(grams, identity, F.col("_grams"))
    weights = tf.tfidf(counts, identity, terms, sublinear, bounded=len(vocab), carry=("coef",))
    values = weights.select(identity, "term", (F.col("weight") * F.col("coef")).alias("value"))
    return word_contributions(read, values, identity, text, lo, hi)
