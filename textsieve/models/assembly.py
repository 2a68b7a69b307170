"""Training sets assembled by year and kind of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..operators.ranking import take_seeded

KEPT_FAKES = (fx.KIND_QUOTED, fx.KIND_OTHER)


def _as_many_true(rows: DataFrame, fake: DataFrame, identity: str, seed: int) -> DataFrame:
    n = fake.agg(F.count(F.lit(1))).scalar()
    return take_seeded(rows.where(F.col("kind") == fx.KIND_TRUE), identity, n, seed)


def balanced_years(
    rows: DataFrame, identity: str, years: tuple[int, int], fakes: Sequence[str] = KEPT_FAKES, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Fakes of some kinds and years, and equally many seeded trues of the same years."""
    inside = rows.where(F.col("year").between(*years))
    fake = inside.where(F.col("kind").isin(list(fakes)))
    return fake, _as_many_true(inside, fake, identity, seed)


def temporal_variants(
    rows: DataFrame,
    identity: str,
    years: tuple[int, int],
    fakes: Sequence[str] = KEPT_FAKES,
    described: str = "described",
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Additions to a base corpus: fakes with trues, fakes alone, fakes without descriptions with trues."""
    fake, true = balanced_years(rows, identity, years, fakes, seed)
    plain = fake.where(~F.col(described))
    fewer = _as_many_true(rows.where(F.col("year").between(*years)), plain, identity, seed)

    def tag(frame: DataFrame, label: str) -> DataFrame:
        return frame.withColumn("target", F.lit(label))

    return {
        "fake and true": tag(fake, "fake").unionByName(tag(true, "true")),
        "fake only": tag(fake, "fake"),
        "without described": tag(plain, "fake").unionByName(tag(fewer, "true")),
    }
