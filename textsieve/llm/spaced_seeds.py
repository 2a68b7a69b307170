"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring tokens; the hash of a window ignores the positions that the mask
leaves out, so a substitution there does not change it. ``MASKS`` are three masks of weight six that together
hit every stretch of 20 aligned tokens with at most 4 substitutions (a test tries all 4,845 ways to place them).
Hashes of test items and of documents are joined; around each hit the aligned tokens are compared, and a
document is contaminated by an item if some ``overlap`` tokens in a row (all of a shorter item) agree in at least
``percent`` of the positions.

A document's windows are looked up in a Bloom filter over the item hashes before anything is shuffled. Its size
is fixed (``FILTER_BITS``), whatever the number of items: with more items it passes more windows to the join,
which decides. What is shuffled is the surroundings of hits, not texts.

Defined cases: null or empty texts and items match nothing; items or documents of fewer tokens than the
shortest mask match nothing; repeated items and repeated documents are reported each; items shorter than
``overlap`` must agree as a whole. Texts of any length are read whole. Without items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import kept
from .words import mix, words

#: Weight six each; 1 counts, 0 is ignored.
MASKS = ("1111011", "1110100011", "1110111")
OVERLAP = 20
PERCENT = 80
FILTER_BITS = 1 << 24
_SPREAD = np.uint64(0x9FB21C651E98DF25)


def seed_hashes(tokens: np.ndarray, mask: str, which: int) -> np.ndarray:
    """Hash of every window of a token sequence under one mask."""
    n = max(0, len(tokens) - len(mask) + 1)
    value = np.full(n, which + 1, dtype=np.uint64)
    for k, counts in enumerate(mask):
        if counts == "1":
            value = (value ^ tokens[k : k + n]) * _SPREAD
            value ^= value >> np.uint64(29)
    return mix(value)


def item_tokens(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``tokens`` of every item with a token."""
    rows = items.select(items[f"`{item}`"].cast("long").alias("item"), items[f"`{text}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column(1)):
                part = batch.column(0).slice(found.first, found.last - found.first)
                tokens = pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(found.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part, tokens], names=["item", "tokens"])

    return rows.mapInArrow(run, "item bigint, tokens array<bigint>").where(F.size("tokens") > 0)


def item_seeds(items: DataFrame) -> DataFrame:
    """``hash``, ``item``, ``at`` of every window of the items' tokens under every mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens"), strict=True):
                flat = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for which, mask in enumerate(MASKS):
                    hashes = seed_hashes(flat, mask, which)
                    out.append((hashes.view(np.int64), np.full(len(hashes), item, dtype=np.int64), np.arange(len(hashes), dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["hash", "item", "at"])

    return items.select("item", "tokens").mapInArrow(run, "hash bigint, item bigint, at bigint")


def document_hits(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", around: int = OVERLAP) -> DataFrame:
    """Regions of documents with windows that pass the filter.

    ``row``, ``key``, ``region``, ``begin`` (token position), ``tokens`` and ``hits`` (hash, position in the document).
    """
    bits = len(table) * 8
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{key}`"].cast("long").alias("key"), docs[f"`{text}`"].cast("string").alias("text"))
    names = ["row", "key", "region", "begin", "tokens", "hits"]
    hit_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))
    longest = max(map(len, MASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            out: list[tuple] = []
            for found in words(batch.column(2)):
                row_of = np.repeat(np.arange(len(found.counts)), found.counts)
                at, hashes = [], []
                for which, mask in enumerate(MASKS):
                    values = seed_hashes(found.hashes, mask, which)
                    a, b = bloom.places(values, bits)
                    k = np.flatnonzero(bloom.holds(seen, a))
                    k = k[bloom.holds(seen, b[k])]
                    k = k[row_of[k] == row_of[k + len(mask) - 1]]
                    at.append(k)
                    hashes.append(values[k])
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                # hits whose surroundings touch are one region
                new = np.flatnonzero((np.diff(at) > 2 * around + longest) | (np.diff(row_of[at]) != 0)) + 1
                offsets = found.offsets
                for region, (lo, hi) in enumerate(zip([0, *new], [*new, len(at)], strict=True)):
                    r = int(row_of[at[lo]])
                    begin = max(int(offsets[r]), int(at[lo]) - around)
                    end = min(int(offsets[r + 1]), int(at[hi - 1]) + longest + around)
                    hits = [{"hash": h, "at": p} for h, p in zip(hashes[lo:hi].view(np.int64).tolist(), (at[lo:hi] - offsets[r]).tolist(), strict=True)]
                    i = found.first + r
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), region, begin - int(offsets[r]), found.hashes[begin:end].view(np.int64), hits))
                if len(out) > 5000:
                    yield _rows(out, names, hit_type)
                    out = []
            if out:
                yield _rows(out, names, hit_type)

    return rows.mapInArrow(run, "row bigint, key bigint, region bigint, begin bigint, tokens array<bigint>, hits array<struct<hash:bigint,at:bigint>>")


def _rows(out: list[tuple], names: list[str], hit_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), hit_type]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def best_overlap(left: np.ndarray, right: np.ndarray, shift: int, overlap: int = OVERLAP, percent: int = PERCENT) -> int:
    """Most agreeing tokens in ``overlap`` aligned ones (all of ``right`` if it is shorter), 0 if below ``percent``.

    ``left[shift + i]`` is aligned with ``right[i]``.
    """
    width = min(overlap, len(right))
    first, last = max(0, -shift), min(len(right), len(left) - shift)
    if last - first < width or width == 0:
        return 0
    agree = left[first + shift : last + shift] == right[first:last]
    sums = np.concatenate([[0], np.cumsum(agree)])
    most = int((sums[width:] - sums[:-width]).max())
    return most if 100 * most >= percent * width else 0


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", overlap: int = OVERLAP, percent: int = PERCENT) -> DataFrame:
    """``row``, ``key``, ``item_id``, ``matched``: contaminated documents with each item they hold.

    ``row`` tells repeated documents apart; ``matched`` counts agreeing tokens in the best stretch.
    """
    tokens = kept(item_tokens(items, item, item_text), "items")
    seeds = kept(item_seeds(tokens), "seeds")
    table = bloom.build(seeds, "hash", FILTER_BITS)
    regions = kept(document_hits(docs, table, key, text, overlap), "hits")
    hits = regions.select("row", "region", "begin", F.explode("hits").alias("x")).select("row", "region", "begin", F.col("x.hash").alias("hash"), F.col("x.at").alias("doc_at"))
    lines = hits.join(seeds, "hash").select("row", "region", "item", (F.col("doc_at") - F.col("begin") - F.col("at")).alias("shift")).distinct()
    met = lines.join(regions.select("row", "region", "key", F.col("tokens").alias("left")), ["row", "region"]).join(tokens.select("item", F.col("tokens").alias("right")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts = batch.column(3).to_pylist()
            lefts, rights = batch.column(4), batch.column(5)
            found = [best_overlap(lefts[i].values.to_numpy(), rights[i].values.to_numpy(), shifts[i], overlap, percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names=["row", "key", "item_id", "matched"])

    checked = met.select("row", "key", "item", "shift", "left", "right").mapInArrow(verify, "row bigint, key bigint, item_id bigint, matched bigint")
    return checked.where(F.col("matched") > 0).groupBy("row", "key", "item_id").agg(F.max("matched").alias("matched"))
