"""Study protocols: grouped folds, out-of-fold scores, blends, data and source studies, grid, freeze."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_words, score_to_label, word_count
from ..operators import groups as gr
from ..operators import metrics as me
from ..operators.scaling import standardize
from ..operators.splits import grouped_folds
from ..session import cut_lineage
from . import training as tr
from .blend import blend_scores
from .specs import Embedding, Spec, grid
from .training import in_parallel

def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def with_folds(rows: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Rows with their group's fold; refuses fewer groups than folds, which would leave a fold empty."""
    folds = grouped_folds(rows, group, label, k, seed)
    found = folds.limit(k).count()
    if found < k:
        raise ValueError(f"{k} folds need as many groups, got {found}")
    return gr.join_null_safe(rows, folds, [group])


def out_of_fold(rows: DataFrame, spec: Spec, identity: str, k: int, mixed: bool = False) -> DataFrame:
    """``(id, fold, label, score, predicted)`` where every row is scored by a model that never saw its group.

    ``rows`` carry a ``fold`` column and are written once. Vocabularies and idf of all k training sides come from one
    scan of the texts, by subtracting the counts of the held-out fold.
    """
    rows = cut_lineage(rows)
    stages = tr.fold_stages(rows, spec, "fold", mixed)

    def one(fold: int) -> DataFrame:
        model = tr.train(rows.where(F.col("fold") != fold), spec, mixed, stages=stages.get(fold))
        held = rows.where(F.col("fold") == fold)
        return tr.score(model, held, words=None).select(identity, "fold", "label", "score", "predicted")

    return union_all(in_parallel(lambda f=f: one(f) for f in range(k)))


def cross_validate(rows: DataFrame, spec: Spec, identity: str, group: str, k: int = 5, mixed: bool = False) -> DataFrame:
    """One row: mean and population deviation of accuracy and macro F1 over grouped folds."""
    folded = with_folds(rows, group, "label", k)
    per_fold = me.evaluate(out_of_fold(folded, spec, identity, k, mixed), ["fold"])
    return per_fold.agg(
        F.avg("accuracy").alias("accuracy"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1_macro").alias("f1_macro"),
        F.stddev_pop("f1_macro").alias("f1_macro_std"),
    )


def train_all(rows: DataFrame, specs: dict[str, Spec], mixed: bool = True) -> dict[str, PipelineModel]:
    """A model for every spec. Specs with equal blocks and class weights share one feature table.

    The texts and every feature table are written once, and every vocabulary is learned once. Feature tables are built first, then all
    classifiers are fitted, both as jobs side by side.
    """
    shared: dict[tuple, list[str]] = {}
    for name, spec in specs.items():
        shared.setdefault((spec.blocks, spec.balanced), []).append(name)
    texts = tr.learning_texts(rows, mixed)
    stages = tr.shared_stages(texts, [specs[names[0]] for names in shared.values()])
    tables = in_parallel(
        lambda n=names[0], s=made: tr.learned_features(texts, specs[n], stages=s, written=True)
        for names, made in zip(shared.values(), stages)
    )
    of_name = {name: made for names, made in zip(shared.values(), tables) for name in names}

    def one(name: str) -> PipelineModel:
        features, learned, total = of_name[name]
        return PipelineModel([*features.stages, tr.fitted(tr.classifier(specs[name], total), learned)])

    return dict(zip(specs, in_parallel(lambda n=n: one(n) for n in specs)))


def compare(
    train_rows: DataFrame, test_rows: DataFrame, specs: dict[str, Spec], mixed: bool = True, study: str = ""
) -> DataFrame:
    """Every spec trained on the same rows and measured on the same test rows."""
    scored = tr.score_many(train_all(train_rows, specs, mixed), test_rows)
    return me.evaluate(scored.withColumnRenamed("method", "experiment"), ["experiment"]).withColumn("study", F.lit(study))


def data_study(
    corpora: DataFrame, test_rows: DataFrame, combos: Sequence[str], spec: Spec, mixed: bool = True
) -> DataFrame:
    """The same model on combinations of named corpora; ``extx3`` repeats a part.

    Texts are cut and written once for all combinations. A combination whose rows are all of one class predicts that class.
    """
    texts = tr.learning_texts(corpora, mixed, carry=("corpus",))
    classes: dict[str, set[str]] = {}
    for row in texts.select("corpus", "label").distinct().collect():
        classes.setdefault(row["corpus"], set()).add(row["label"])

    def one(combo: str) -> DataFrame:
        names, repeats = gr.parse_combo(combo)
        seen = set().union(*[classes.get(n, set()) for n in names])
        if len(seen) == 1:
            scored = test_rows.withColumn("predicted", F.lit(*seen))
        else:
            features, learned, total = tr.learned_features(gr.choose_corpora(texts, names, repeats), spec, written=True)
            scored = tr.score(PipelineModel([*features.stages, tr.fitted(tr.classifier(spec, total), learned)]), test_rows)
        return scored.select("label", "predicted", F.lit(combo).alias("experiment"))

    frames = in_parallel(lambda c=c: one(c) for c in combos)
    return me.evaluate(union_all(frames), ["experiment"])


def source_hold_out(
    rows: DataFrame, held: Sequence[Sequence[str]], spec: Spec, mixed: bool = True, extra: DataFrame | None = None
) -> DataFrame:
    """Train without some sources, measure on those only; ``extra`` rows always join the training side."""

    def one(names: Sequence[str]) -> DataFrame:
        inside, outside = gr.hold_out(rows, "source", names)
        used = inside if extra is None else inside.unionByName(extra, allowMissingColumns=True)
        scored = tr.score(tr.train(used, spec, mixed), outside)
        return scored.select("label", "predicted", F.lit("/".join(names)).alias("without"))

    frames = in_parallel(lambda h=h: one(h) for h in held)
    return me.evaluate(union_all(frames), ["without"])


def single_source_pairs(rows: DataFrame, group: str, source: str, chosen: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training groups wholly from the chosen sources; test rows from all other sources."""
    marked = rows.withColumn("_in", F.col(source).isin(list(chosen)))
    facts = gr.with_group_facts(marked, [group], _whole=F.bool_and("_in"))
    return facts.where("_whole").drop("_in", "_whole"), marked.where(~F.col("_in")).drop("_in")


def length_schemes(train_rows: DataFrame, test_rows: DataFrame, spec: Spec, lengths=(30, 50, 100)) -> DataFrame:
    """Training on 50 words, on mixed lengths and on whole texts, against test lengths, as a pivot."""
    fifty = train_rows.withColumn("text", first_words("text", 50))
    schemes = {"50 words": (fifty, False), "mixed": (train_rows, True), "whole text": (train_rows, False)}

    def one(name: str) -> DataFrame:
        data, mixed = schemes[name]
        model = tr.train(data, spec, mixed)
        parts = [
            tr.score(model, test_rows.where(word_count("text") >= n), words=n).select(
                "label", "predicted", F.lit(name).alias("scheme"), F.lit(n).alias("n_test")
            )
            for n in lengths
        ]
        return union_all(parts)

    frames = in_parallel(lambda s=s: one(s) for s in schemes)
    cells = me.evaluate(union_all(frames), ["scheme", "n_test"])
    return cells.groupBy("scheme").pivot("n_test", list(lengths)).agg(F.first("bal_acc"))


def hybrid(train_rows: DataFrame, test_rows: DataFrame, specs: Sequence[Spec], identity: str, group: str, k: int = 3):
    """Mean of standardised scores and a stacked logistic regression.

    Scaler and stack learn from out-of-fold scores of the training rows only. Returns the scored
    test rows ``(id, label, method, predicted)`` and the learned stack weights.
    """
    folded = with_folds(train_rows, group, "label", k).persist()
    names = [f"s{i}" for i in range(len(specs))]

    def one(name: str, spec: Spec) -> tuple[DataFrame, DataFrame]:
        part = out_of_fold(folded, spec, identity, k).select(identity, "label", F.col("score").alias(name))
        seen = tr.score(tr.train(train_rows, spec, mixed=False), test_rows, words=None)
        return part, seen.select(identity, "label", F.col("score").alias(name))

    oof, test = None, None
    for part, seen in in_parallel(lambda n=n, s=s: one(n, s) for n, s in zip(names, specs)):
        oof = part if oof is None else oof.join(part.drop("label"), identity)
        test = seen if test is None else test.join(seen.drop("label"), identity)
    oof = oof.persist()
    blended = blend_scores(test, names, fit_on=oof)
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    target = F.when(F.col("label") == "true", 1.0).otherwise(0.0)
    scaled = assemble.transform(standardize(oof, names)).withColumn("_y", target)
    n = scaled.count()
    stack = LogisticRegression(labelCol="_y", regParam=1.0 / n, standardization=False).fit(scaled)
    margin = vector_to_array("rawPrediction")[1]
    stacked = stack.transform(assemble.transform(standardize(test, names, fit_on=oof)))
    rows = union_all(
        [
            blended.select(identity, "label", F.lit("hybrid").alias("method"), score_to_label("score").alias("predicted")),
            stacked.select(identity, "label", F.lit("stack").alias("method"), score_to_label(margin).alias("predicted")),
        ]
    )
    return rows, [float(w) for w in stack.coefficients]


def unseen_sources(rows: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Training and test rows without a source in common: one grouped fold of k is held out."""
    folded = with_folds(rows, "source", "label", k)
    return folded.where("fold <> 0").drop("fold"), folded.where("fold = 0").drop("fold")


GRID_KEYS = ["repr", "c", "min_df", "sublinear"]


def grid_search(train_rows: DataFrame, test_rows: DataFrame, settings=None) -> DataFrame:
    """Test metrics and number of features of every setting; features are built once per representation, for all C."""
    settings = settings or grid()
    specs = {str(i): Spec((block,), c=c, balanced=False) for i, (_, block, c) in enumerate(settings)}
    models = train_all(train_rows, specs, mixed=False)
    points = [
        (str(i), name, c, block.min_df, block.sublinear, models[str(i)].stages[-1].numFeatures)
        for i, (name, block, c) in enumerate(settings)
    ]
    schema = "method string, repr string, c double, min_df int, sublinear boolean, n_features long"
    measured = me.evaluate(tr.score_many(models, test_rows, words=None), ["method"])
    return train_rows.sparkSession.createDataFrame(points, schema).join(measured, "method").drop("method")


def grid_sizes(rows: DataFrame, settings=None) -> DataFrame:
    """Every setting with the number of features its training rows give it, counted once per representation."""
    settings = settings or grid()
    sizes = []
    for name, block in {name: block for name, block, _ in settings}.items():
        grams = block.stages("text", "_of")[0].transform(rows)
        terms = grams.select(F.explode(F.array_distinct("_of_grams")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = [
            F.struct(F.lit(m).alias("min_df"), F.count_if(F.col("df") >= m).alias("n"))
            for m in sorted({b.min_df for n, b, _ in settings if n == name})
        ]
        sizes.append(terms.agg(F.array(*known).alias("sizes")).select(F.lit(name).alias("repr"), F.inline("sizes")))
    points = [(name, c, block.min_df, block.sublinear, block.max_features) for name, block, c in settings]
    frame = rows.sparkSession.createDataFrame(points, "repr string, c double, min_df int, sublinear boolean, most long")
    return frame.join(union_all(sizes), ["repr", "min_df"]).select(*GRID_KEYS, F.least("n", "most").alias("n_features"))


def by_setting(measured: DataFrame, metric: str = "bal_acc", keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Mean and best of a metric for every value of every grid key: ``(setting, value, n, mean, best)``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("setting"), F.col(k).cast("string").alias("value")) for k in keys])
    long = measured.select(F.explode(pairs).alias("p"), metric).select("p.*", metric)
    return long.groupBy("setting", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.max(metric).alias("best")
    )


def freeze(rows: DataFrame, methods: dict[str, Spec], folder: str, own: dict[str, DataFrame] | None = None) -> list[str]:
    """Train and save every method. No test table is read here.

    ``own`` gives the rows of methods that learn from others. Methods over embeddings learn from the rows that have one, once each.
    """
    own, names = own or {}, list(methods)
    embedded = {n: s for n, s in methods.items() if any(isinstance(b, Embedding) for b in s.blocks)}
    rest = {n: s for n, s in methods.items() if n not in embedded and n not in own}
    jobs = [lambda: train_all(rows.drop("embedding"), rest)] if rest else []
    if embedded:
        jobs.append(lambda: train_all(rows.where(F.col("embedding").isNotNull()), embedded, mixed=False))
    jobs += [lambda n=n: {n: tr.train(own[n], methods[n])} for n in own]
    models = {n: model for made in in_parallel(jobs) for n, model in made.items()}
    return in_parallel(lambda n=n: tr.save(models[n], folder, names, n) for n in names)


def evaluate_frozen(tests: DataFrame, names: Sequence[str], folder: str, overall: str = "all") -> tuple[DataFrame, DataFrame]:
    """Metrics with intervals per method and test plus all tests together, and one prediction per item."""
    models: dict[str, PipelineModel] = dict(zip(names, in_parallel(lambda n=n: tr.load(folder, names, n) for n in names)))
    predictions = tr.score_many(models, tests)
    both = predictions.withColumn("test", F.explode(F.array("test", F.lit(overall))))
    return me.full_metrics(both, ["method", "test"]), predictions
