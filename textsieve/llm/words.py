"""Vectorised words and shingles over Arrow batches: numpy on the UTF-8 bytes, no Python per word.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; all these characters are single bytes in
UTF-8, so the bytes can be cut without decoding. A word's hash is a polynomial over its bytes modulo
2**64 with a random value per byte, mixed at the end; a shingle's hash mixes those of its words in order.
Null texts count as empty. Memory follows the longest single text, about 60 bytes for each of its bytes,
or ``CHUNK`` bytes of text if all are shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer texts are handled alone.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 5  # odd: it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_VALUES = _byte_values()


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK + 1:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of rows ``first`` to ``last`` (excluded) of a batch."""

    first: int
    last: int
    counts: np.ndarray  # words of each row
    hashes: np.ndarray  # of all words in order
    data: np.ndarray  # bytes of these rows
    starts: np.ndarray  # byte positions of the words in data
    ends: np.ndarray
    bounds: np.ndarray  # byte positions of the rows in data, one more than rows

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def arrow_text(column) -> pa.LargeStringArray:
    """One array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a text column."""
    text = arrow_text(column)
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, bounds


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most CHUNK bytes; a longer row is a run of its own."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(column) -> Iterator[Words]:
    """Words of a text column, in runs of rows that cover it in order."""
    data, bounds = bytes_of(column)
    for first, last in slices(bounds):
        part = data[bounds[first] : bounds[last]]
        edges = bounds[first : last + 1] - bounds[first]
        n = len(part)
        inside = ~_SPACE[part]
        opens, closes = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        opens[:n] = inside
        opens[1:n] &= ~inside[: n - 1]
        closes[1:] = inside
        closes[1:n] &= ~inside[1:]
        cut = edges[(edges > 0) & (edges < n)]
        cut = cut[inside[cut] & inside[cut - 1]]
        opens[cut] = True
        closes[cut] = True
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * up[:n], dtype=np.uint64, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        counts = np.diff(np.searchsorted(starts, edges))
        yield Words(first, last, counts, hashes, part, starts, ends, edges)


def window_hashes(found: Words, width: int, short_as_one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, with repeats: counts per row, flat hashes.

    ``short_as_one``: a row of fewer words, but at least one, gives one hash of its whole sequence.
    """
    hashes, counts, offsets = found.hashes, found.counts, found.offsets
    total = len(hashes)
    mixed = np.zeros(max(0, total - width + 1), dtype=np.uint64)
    for k in range(width):
        mixed = mix(mixed + hashes[k : k + len(mixed)] * _WORD_FACTORS[k % 3])
    row = np.repeat(np.arange(len(counts)), counts)
    keep = row[: len(mixed)] == row[width - 1 :] if len(mixed) else np.zeros(0, dtype=bool)
    flat, sizes = mixed[keep], np.maximum(counts - width + 1, 0)
    if short_as_one and (short := np.flatnonzero((counts > 0) & (counts < width))).size:
        ends = np.cumsum(sizes)
        extra = []
        for i in short:
            value = np.array([width * 1_000_003 + int(counts[i])], dtype=np.uint64)
            for k in range(int(counts[i])):
                value = mix(value + hashes[offsets[i] + k : offsets[i] + k + 1] * _WORD_FACTORS[k % 3])
            extra.append(value)
        flat = np.insert(flat, ends[short], np.concatenate(extra))
        sizes = sizes.copy()
        sizes[short] = 1
    return sizes, flat


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, in order; empty for a row without words."""
    for found in words(column):
        sizes, flat = window_hashes(found, width, short_as_one=True)
        ends = np.cumsum(sizes)
        for end, size in zip(ends, sizes, strict=True):
            yield np.unique(flat[end - size : end])
