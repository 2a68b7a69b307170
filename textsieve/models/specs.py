"""Model descriptions and the named variants."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler

from . import stages as st


@dataclass(frozen=True)
class TextBlock:
    """TF-IDF over word or padded character n-grams."""

    analyzer: str = "word"
    lo: int = 1
    hi: int = 2
    max_features: int | None = 50_000
    min_df: int = 1
    sublinear: bool = False
    lowercase: bool = True
    mask_digits: bool = False

    def stages(self, text: str, out: str) -> list:
        return [
            st.GramTokenizer(
                inputCol=text, outputCol=f"{out}_grams", analyzer=self.analyzer, lo=self.lo, hi=self.hi,
                lowercase=self.lowercase, maskDigits=self.mask_digits,
            ),
            st.TfidfEstimator(
                inputCol=f"{out}_grams", outputCol=out, maxFeatures=self.max_features or 0, minDF=self.min_df,
                sublinear=self.sublinear,
            ),
        ]


@dataclass(frozen=True)
class Numbers:
    mode: str = "categories"
    weight: float = 1.0

    def stages(self, text: str, out: str) -> list:
        return [st.NumberBlock(inputCol=text, outputCol=out, mode=self.mode, weight=self.weight)]


@dataclass(frozen=True)
class Columns:
    expressions: tuple[str, ...] = ("ln(1 + length(text))",)

    def stages(self, text: str, out: str) -> list:
        return [st.ColumnBlock(expressions=list(self.expressions), outputCol=out)]


@dataclass(frozen=True)
class Embedding:
    column: str = "embedding"

    def stages(self, text: str, out: str) -> list:
        return [st.UnitEmbedding(inputCol=self.column, outputCol=out)]


@dataclass(frozen=True)
class Spec:
    """Feature blocks side by side, then one linear classifier."""

    blocks: tuple = (TextBlock(),)
    classifier: str = "svm"
    c: float = 1.0
    balanced: bool = True
    max_iter: int = 300

    def outputs(self) -> list[str]:
        """Names of the blocks' vectors."""
        return ["features"] if len(self.blocks) == 1 else [f"block{i}" for i in range(len(self.blocks))]

    def stages(self, text: str = "text") -> list:
        out = [s for name, block in zip(self.outputs(), self.blocks) for s in block.stages(text, name)]
        return out if len(self.blocks) == 1 else [*out, VectorAssembler(inputCols=self.outputs(), outputCol="features")]


WORDS = TextBlock()
CHARS = TextBlock("char_wb", 2, 5, 200_000, sublinear=True)
PLAIN = Spec(balanced=False)
BASE = Spec()
CHOSEN = Spec((CHARS,))
SIZE_ONLY = Spec((Columns(),), balanced=False, max_iter=10)


def text_variants() -> dict[str, Spec]:
    """Twelve representations and classifiers compared on the same data."""
    damped = replace(WORDS, sublinear=True)
    return {
        "word(1,2) C=1": BASE,
        "word(1,2) C=0.1": Spec(c=0.1),
        "word(1,2) C=0.3": Spec(c=0.3),
        "word(1,2) C=3": Spec(c=3.0),
        "word(1,2) sublinear": Spec((damped,)),
        "word(1,2) all terms, min_df=2": Spec((replace(WORDS, max_features=None, min_df=2),)),
        "word(1,2) cased": Spec((replace(WORDS, lowercase=False),)),
        "word(1,1)": Spec((replace(WORDS, hi=1),)),
        "char_wb(2,5)": CHOSEN,
        "word(1,2) + char_wb(2,5)": Spec((damped, CHARS)),
        "word(1,2) + char_wb(2,5) cased": Spec((damped, replace(CHARS, lowercase=False))),
        "logreg word(1,2) C=10": Spec((damped,), classifier="logreg", c=10.0),
    }


def number_variants() -> dict[str, Spec]:
    """Ten models about numbers in the text."""

    def alone(mode: str) -> Spec:
        return Spec((Numbers(mode),), classifier="logreg")

    return {
        "length (control)": alone("length"),
        "numbers: count": alone("count"),
        "numbers: pct": alone("pct"),
        "numbers: smooth": alone("smooth"),
        "numbers: categories": alone("categories"),
        "tfidf": BASE,
        "tfidf + smooth (weight 1)": Spec((WORDS, Numbers("smooth", 1.0))),
        "tfidf + categories (weight 0.3)": Spec((WORDS, Numbers("categories", 0.3))),
        "tfidf + categories (weight 1)": Spec((WORDS, Numbers("categories", 1.0))),
        "tfidf digits masked": Spec((replace(WORDS, mask_digits=True),)),
    }


def final_methods() -> dict[str, Spec]:
    """The eight methods of the single final evaluation, in report order; those of ``EARLIER`` learn from rows of their own."""
    variants, numbers = text_variants(), number_variants()
    return {
        "saved: docs": PLAIN,
        "saved: docs + open": BASE,
        "words": BASE,
        "characters": CHOSEN,
        "words + characters (cased)": variants["word(1,2) + char_wb(2,5) cased"],
        "embeddings": Spec((Embedding(),), classifier="logreg", c=10.0),
        "numbers only": numbers["numbers: categories"],
        "words + numbers": numbers["tfidf + categories (weight 1)"],
    }


#: Methods that were saved before the study, with the corpora they learned from.
EARLIER = {"saved: docs": ("docs",), "saved: docs + open": ("docs", "open")}


def data_combinations() -> list[str]:
    """The 17 training sets of the data study: 11 combinations of four corpora, and three of them with the last one repeated."""
    plain = [
        "docs", "docs+open", "docs+talk", "open", "talk", "bench",
        "docs+bench", "open+bench", "talk+bench", "docs+open+bench", "docs+talk+bench",
    ]
    return [*plain, *[f"{c}x{k}" for c in ("docs+open+bench", "docs+talk+bench", "talk+bench") for k in (3, 5)]]


def grid() -> list[tuple[str, TextBlock, float]]:
    """48 settings: 4 representations x 3 C x 2 min_df x 2 count weightings."""
    shapes = {
        "word (1,1)": TextBlock(hi=1),
        "word (1,2)": TextBlock(hi=2),
        "word (1,3)": TextBlock(hi=3),
        "char_wb (3,5)": TextBlock("char_wb", 3, 5),
    }
    return [
        (name, replace(block, min_df=min_df, sublinear=sublinear), c)
        for name, block in shapes.items()
        for min_df in (1, 3)
        for sublinear in (False, True)
        for c in (0.1, 1.0, 10.0)
    ]
