"""Quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams of a document are hashed into buckets with a learned vector each;
the document is the mean of its vectors, a softmax over two outputs gives the probability of label 1. A pair of
equal words is one gram for all words. The biases are the log shares of the labels. Vectors and outputs are
trained together by stochastic gradient descent in numpy, one document at a time.

Fitting is bounded and documented: ``max_rows`` labelled rows, taken by a hash of their key, with all n-grams of
each, as counts of buckets. So the driver holds at most ``max_rows * buckets`` counts, whatever the corpus; it gets
and keeps them packed and opens one row at a time. Scoring reads every n-gram of every text: the output is
linear in the mean, so each bucket's vector is multiplied by the outputs once and a text costs one table look
per n-gram.

Defined cases: a null or empty text, or one without any n-gram, gets the score of the output biases; repeated
rows count once each; with labels of one class only, or none, the score is that class's (0.5 without rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, window_hashes, words


#: Stands for every pair of a word and itself, so that repetition is learned across words.
_TWICE = np.uint64(0x5D588B656C078965)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dimensions: int = 8
    char_sizes: tuple[int, ...] = (3, 4)
    max_rows: int = 4000
    epochs: int = 6
    rate: float = 0.5
    seed: int = 17


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # buckets x dimensions
    outputs: np.ndarray  # dimensions x 2
    biases: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def bucket_scores(self) -> np.ndarray:
        """What a gram of each bucket adds to the logit of label 1, before the mean."""
        return self.vectors.astype(np.float64) @ (self.outputs[:, 1] - self.outputs[:, 0]).astype(np.float64)

    def bias(self) -> float:
        return float(self.biases[1] - self.biases[0])


def gram_ids(found: Words, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all grams of each row of a run, row after row: counts per row, flat ids."""
    rows = len(found.counts)
    pair_counts, pairs = window_hashes(found, 2, short_as_one=False)
    same, own = found.hashes[1:] == found.hashes[:-1], np.repeat(np.arange(rows), found.counts)
    pairs[same[own[1:] == own[:-1]]] = _TWICE
    groups = [(found.counts, found.hashes), (pair_counts, pairs)]
    data = found.data
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) == len(heads):
        chars, at = points.astype(np.uint64), np.searchsorted(heads, found.bounds)
    else:  # broken UTF-8: bytes stand for characters
        chars, at = data.astype(np.uint64), found.bounds
    row = np.repeat(np.arange(rows), np.diff(at))
    for size in settings.char_sizes:
        n = max(0, len(chars) - size + 1)
        value = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            value = (value << np.uint64(15)) ^ (value >> np.uint64(41)) ^ chars[k : k + n]
        keep = row[:n] == row[size - 1 : size - 1 + n]
        groups.append((np.maximum(np.diff(at) - size + 1, 0), mix(value)[keep]))
    mask = np.uint64(settings.buckets - 1)
    counts = sum(np.asarray(c) for c, _ in groups)
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if rows else 0, dtype=np.int64)
    place = ends - counts
    for kind, (sizes, hashes) in enumerate(groups):
        sizes = np.asarray(sizes)
        start = np.cumsum(sizes) - sizes
        flat[np.repeat(place - start, sizes) + np.arange(len(hashes))] = ((hashes + np.uint64(kind * 0x9E3779B9)) & mask).astype(np.int64)
        place = place + sizes
    return counts, flat


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered distinct bucket ids, as steps, and their counts, in a few bits each."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype(np.int32).tobytes(), 1)


class PackedRows(Sequence):
    """Rows of distinct bucket ids, their counts and label, opened when they are asked for."""

    def __init__(self, grams: pa.ChunkedArray, labels: list[int]) -> None:
        self.grams, self.labels = [x.as_buffer() for x in grams], labels

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        steps, counts = np.split(np.frombuffer(zlib.decompress(self.grams[i]), np.int32), 2)
        return np.cumsum(steps), counts, self.labels[i]


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Vectors and outputs from rows of distinct bucket ids, their counts and label."""
    rng = np.random.default_rng(settings.seed)
    vectors = np.zeros((settings.buckets, settings.dimensions), dtype=np.float32)
    outputs = rng.normal(0, 1, (settings.dimensions, 2)).astype(np.float32)
    outputs[:, 1] = -outputs[:, 0]
    ones = sum(rows.labels if isinstance(rows, PackedRows) else [label for _, _, label in rows])
    prior = (ones + 0.5) / (len(rows) + 1.0)
    biases = np.array([np.log(1 - prior), np.log(prior)]) if rows else np.zeros(2)
    model = Model(settings, vectors, outputs, biases)
    if not rows or ones in (0, len(rows)):
        return model
    step, steps = 0, settings.epochs * len(rows)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            rate = settings.rate * (1 - step / steps)
            step += 1
            ids, counts, label = rows[i]
            if not len(ids):
                continue
            weights = (counts / counts.sum()).astype(np.float32)
            mean = weights @ vectors[ids]
            logits = mean @ outputs + biases
            chance = np.exp(logits - logits.max())
            error = (chance / chance.sum()).astype(np.float32)
            error[label] -= 1
            back = outputs @ error
            outputs -= rate * np.outer(mean, error).astype(np.float32)
            # a mean of many vectors moves by rate / n for each of them; the number of kinds scales it back
            vectors[ids] -= (rate * len(ids) ** 0.5) * weights[:, None] * back[None, :]
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> Model:
    """A model from texts and their labels 0 or 1; other labels and null texts teach nothing.

    The label rows are chosen first, at most ``max_rows`` of them, so the side that is broadcast has a fixed bound.
    """
    place = F.xxhash64(F.lit("quality sample"), F.col("key"))
    chosen = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    chosen = chosen.withColumn("place", place).orderBy("place", "label").limit(settings.max_rows)
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].cast("string").alias("text")).where(F.col("text").isNotNull())
    few = rows.join(F.broadcast(chosen), "key")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column(0)):
                counts, flat = gram_ids(found, settings)
                ends = np.cumsum(counts)
                grams = [np.unique(flat[end - n : end], return_counts=True) for end, n in zip(ends, counts, strict=True)]
                part = batch.slice(found.first, found.last - found.first)
                ties = pa.array([zlib.crc32(g[1].astype(np.int32), zlib.crc32(g[0].astype(np.int32))) for g in grams], pa.int64())
                held = pa.array([packed(*g) for g in grams], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), ties, held], names=["place", "label", "tie", "grams"])

    sampled = few.select("text", "place", "label").mapInArrow(sample, "place bigint, label int, tie bigint, grams binary")
    got = sampled.orderBy("place", "tie").limit(settings.max_rows).toArrow()
    return train(PackedRows(got["grams"], got["label"].to_pylist()), settings)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """``keep`` plus the probability of label 1 of every row's whole text."""
    rows = docs.select(*keep, docs[f"`{text}`"].cast("string").alias("text__"))
    names = rows.columns[:-1]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"`{into}` double"])
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.bias(), model.settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, settings = shared.value
        for batch in batches:
            scores = []
            for found in words(batch.column(len(names))):
                counts, flat = gram_ids(found, settings)
                sums = np.concatenate([[0.0], np.cumsum(table[flat])])
                ends = np.cumsum(counts)
                logits = (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1) + bias
                scores.append(1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500))))
            got = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*names, into])

    return rows.mapInArrow(run, schema)
