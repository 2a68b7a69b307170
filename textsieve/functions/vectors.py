"""Small vector helpers over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let


def unit_length(c) -> Column:
    """Array scaled to length 1; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return let(_col(c).cast("array<double>"), scaled)
