"""ML pipeline stages: gram tokenizer, exact TF-IDF, scaled numeric blocks, unit embeddings.

Fitted TF-IDF is made of built-in stages (count vectors, elementwise product, normalizer), so
scoring runs in the JVM and the model saves and loads as an ordinary pipeline.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ngrams, text as tx
from ..functions.vectors import unit_length
from ..operators import numeric
from ..operators import tfidf as tf
from ..session import cut_lineage

# A linear model is one dense vector per class on the driver, so its width must be bounded.
MAX_WIDTH = 4_000_000


class GramTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text to word or padded character n-grams."""

    analyzer = Param(Params._dummy(), "analyzer", "word or char_wb", TypeConverters.toString)
    lo = Param(Params._dummy(), "lo", "shortest gram", TypeConverters.toInt)
    hi = Param(Params._dummy(), "hi", "longest gram", TypeConverters.toInt)
    lowercase = Param(Params._dummy(), "lowercase", "fold case first", TypeConverters.toBoolean)
    maskDigits = Param(Params._dummy(), "maskDigits", "show every digit as 0", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, analyzer="word", lo=1, hi=1, lowercase=True, maskDigits=False):
        super().__init__()
        self._setDefault(analyzer="word", lo=1, hi=1, lowercase=True, maskDigits=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        subject = F.col(self.getInputCol())
        if self.getOrDefault(self.maskDigits):
            subject = tx.mask_digits(subject)
        lo, hi, low = (self.getOrDefault(p) for p in (self.lo, self.hi, self.lowercase))
        grams = ngrams.char_ngrams if self.getOrDefault(self.analyzer) == "char_wb" else ngrams.word_ngrams
        return dataset.withColumn(self.getOutputCol(), grams(subject, lo, hi, low))


# A vector column opens as a plain struct; it closes again through JSON, inside the JVM.
_CLOSED = T.StructType([T.StructField("v", VectorUDT())])


def _damped(counts):
    opened = F.unwrap_udt(counts)
    closed = tx.let(
        opened,
        lambda v: F.struct(
            v["type"].alias("type"),
            v["size"].alias("size"),
            v["indices"].alias("indices"),
            F.transform(v["values"], lambda x: 1.0 + F.log(x)).alias("values"),
        ),
    )
    return F.from_json(F.to_json(F.struct(closed.alias("v"))), _CLOSED)["v"]


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``1 + ln(count)`` on the stored entries of count vectors."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), _damped(F.col(self.getInputCol())))


class TfidfEstimator(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vocabulary, smoothed idf and unit length from one aggregate over the grams."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "0 keeps all terms", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least number of documents", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "damp counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, maxFeatures=0, minDF=1, sublinear=False):
        super().__init__()
        self._setDefault(maxFeatures=0, minDF=1, sublinear=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        return self.staged(*self.learned(dataset))

    def learned(self, dataset):
        """Vocabulary, as a fitted ``CountVectorizer``, and idf of the grams; neither depends on ``sublinear``."""
        grams = self.getInputCol()
        limit = self.getOrDefault(self.maxFeatures) or MAX_WIDTH + 1
        counted = dataset.select(F.explode(ngrams.run_lengths(F.col(grams))).alias("c")).select("c.*")
        return self.numbered(tf.vocabulary(counted, limit, self.getOrDefault(self.minDF)), dataset.count())

    def of_terms(self, terms, n_rows: int) -> PipelineModel:
        """The fitted stages for a chosen vocabulary ``(term, df)`` of ``n_rows`` texts."""
        return self.staged(*self.numbered(terms, n_rows))

    def numbered(self, terms, n_rows: int):
        """Fitted ``CountVectorizer`` and idf, by its numbers, of a chosen vocabulary."""
        grams, counted = self.getInputCol(), f"{self.getOutputCol()}_counts"
        weight = F.log((1.0 + F.lit(float(n_rows))) / (1.0 + F.col("df"))) + 1.0
        # Written, not cached: equal plans share one cache entry, and fits side by side would drop it for each other.
        chosen = cut_lineage(terms.select(F.array("term").alias(grams), weight.alias("idf")))
        # The chosen terms alone are the input, so all of them are kept and numbered in the JVM.
        counts = CountVectorizer(inputCol=grams, outputCol=counted, vocabSize=MAX_WIDTH + 1, minDF=1.0).fit(chosen.select(grams))
        at = F.get(F.unwrap_udt(counted)["indices"], F.lit(0)).alias("at")
        numbered = counts.transform(chosen).select(at, "idf").toPandas()  # bounded by the model width
        if len(numbered) > MAX_WIDTH:
            raise ValueError(f"more than {MAX_WIDTH} terms; set maxFeatures or raise minDF")
        return counts, numbered.sort_values("at")["idf"].to_numpy()

    def staged(self, counts, idf) -> PipelineModel:
        """The fitted stages, under the column names of this estimator."""
        out = self.getOutputCol()
        counts = counts.copy({counts.inputCol: self.getInputCol(), counts.outputCol: f"{out}_counts"})
        stages, last = [counts], f"{out}_counts"
        if self.getOrDefault(self.sublinear):
            stages.append(SublinearCounts(inputCol=last, outputCol=f"{out}_damped"))
            last = f"{out}_damped"
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=last, outputCol=f"{out}_raw"))
        stages.append(Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out))
        return PipelineModel(stages)


class _ScaledColumns:
    """Shared by the numeric stages: standardised columns as one vector, times a block weight."""

    def _assemble(self, dataset, columns, means, spreads, weight):
        values = [(c - m) / (s if s else 1.0) * weight for c, m, s in zip(columns, means, spreads)]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*values)))

    @staticmethod
    def _moments(dataset, columns):
        stats = dataset.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).collect()[0]
        n = len(columns)
        return [stats[f"m{i}"] or 0.0 for i in range(n)], [stats[f"s{i}"] or 0.0 for i in range(n)]


class NumberBlock(Estimator, HasInputCol, HasOutputCol, _ScaledColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Number rates of a text in one of the modes, standardised and weighted."""

    mode = Param(Params._dummy(), "mode", "number rate mode", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "pseudo words", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "block weight", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, mode="categories", smoothing=20.0, weight=1.0):
        super().__init__()
        self._setDefault(mode="categories", smoothing=20.0, weight=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        mode, m = self.getOrDefault(self.mode), self.getOrDefault(self.smoothing)
        counts = numeric.counted(dataset.select(self.getInputCol()), self.getInputCol())
        rates = numeric.NumberRates(mode, m).fit(counts)
        means, spreads = self._moments(counts, rates.columns())
        return NumberBlockModel(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), mode=mode, smoothing=m,
            weight=self.getOrDefault(self.weight), priors=[float(rates.prior[k]) for k in numeric.COUNTED],
            means=means, spreads=spreads,
        )


class NumberBlockModel(Model, HasInputCol, HasOutputCol, _ScaledColumns, DefaultParamsReadable, DefaultParamsWritable):
    mode = Param(Params._dummy(), "mode", "number rate mode", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "pseudo words", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "block weight", TypeConverters.toFloat)
    priors = Param(Params._dummy(), "priors", "training rates", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "training deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, mode="categories", smoothing=20.0, weight=1.0, priors=None,
                 means=None, spreads=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        rates = numeric.NumberRates(self.getOrDefault(self.mode), self.getOrDefault(self.smoothing))
        rates.prior = dict(zip(numeric.COUNTED, self.getOrDefault(self.priors)))
        counts = numeric.counted(dataset, self.getInputCol())
        made = self._assemble(
            counts, rates.columns(), self.getOrDefault(self.means), self.getOrDefault(self.spreads),
            self.getOrDefault(self.weight),
        )
        return made.drop("n_words", *numeric.COUNTED)


class ColumnBlock(Estimator, HasOutputCol, _ScaledColumns, DefaultParamsReadable, DefaultParamsWritable):
    """Standardised SQL expressions over the row, such as ``ln(1 + length(text))``."""

    expressions = Param(Params._dummy(), "expressions", "SQL expressions", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, expressions=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        exprs = self.getOrDefault(self.expressions)
        means, spreads = self._moments(dataset, [F.expr(e) for e in exprs])
        return ColumnBlockModel(expressions=exprs, outputCol=self.getOutputCol(), means=means, spreads=spreads)


class ColumnBlockModel(Model, HasOutputCol, _ScaledColumns, DefaultParamsReadable, DefaultParamsWritable):
    expressions = Param(Params._dummy(), "expressions", "SQL expressions", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "training deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, expressions=None, outputCol=None, means=None, spreads=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        exprs = [F.expr(e) for e in self.getOrDefault(self.expressions)]
        return self._assemble(dataset, exprs, self.getOrDefault(self.means), self.getOrDefault(self.spreads), 1.0)


class UnitEmbedding(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array column to a vector of length 1."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), array_to_vector(unit_length(self.getInputCol())))
