"""A Bloom filter of fixed size over a column of 64-bit hashes, built in Spark and looked up in numpy.

It saves shuffling rows that no join partner can have. Its size does not follow the data: a full filter lets
more rows pass, and the join behind it decides in any case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of every hash; ``bits`` is a power of two."""
    size = np.uint64(bits - 1)
    return (hashes & size).astype(np.int64), ((hashes >> np.uint64(32)) & size).astype(np.int64)


def build(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits of all hashes in a column; at most ``bits / 64`` rows reach the driver."""
    size = bits - 1
    both = F.explode(F.array(F.col(column).bitwiseAND(F.lit(size)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(size))))
    cells = df.select(both.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell"))
    rows = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[rows["cell"].to_numpy()] = rows["value"].to_numpy()
    return table.view(np.uint8)


def holds(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits at these places are set; the filter stays packed, eight bits a byte."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def passes(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass."""
    a, b = places(hashes, len(packed) * 8)
    found = holds(packed, a)
    found[found] = holds(packed, b[found])
    return found
