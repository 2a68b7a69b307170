"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Every token covers a span of the document's UTF-8 bytes (the
lengths of its vocabulary entries, summed up), and the spans of sections are joined to these intervals by
binary search. A token that lies in one section is counted there. One that crosses boundaries goes to one
section by an explicit rule:

- ``majority``: the section that holds most of its bytes; of equals the first,
- ``start``: the section that holds its first byte, or else the first it reaches,
- ``end``: the section that holds its last byte, or else the last it reaches.

Tokens that touch no section are counted as ``outside``. The counts of a document's sections and ``outside``
add up to its tokens.

Defined cases: a null text has null spans and no tokens; sections are ``array<struct<start,end>>`` in
characters, end excluded, cut at the text's ends; those that are null, empty or reversed count 0; sections
must not overlap, later ones are cut at the end of earlier ones. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
RULES = ("majority", "start", "end")


def ranks_path(name: str = DEFAULT_RANKS) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level encoding of a rank file, and the number of bytes of every id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("textsieve", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens outside all sections, and tokens that cross a boundary of a section.

    Spans are in bytes, sorted and free of overlaps; sections may be empty.
    """
    token_ends = np.cumsum(token_lengths)
    token_starts = token_ends - token_lengths
    counts = np.zeros(len(starts), dtype=np.int64)
    full = np.flatnonzero(ends > starts)
    if not len(token_lengths) or not full.size:
        return counts, len(token_lengths), 0
    s, e = starts[full], ends[full]
    first = np.searchsorted(e, token_starts, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(s, token_ends, side="left") - 1  # the last that starts before its end
    touched = last >= first
    lo, hi = np.minimum(first, len(full) - 1), np.maximum(last, 0)
    within = touched & (s[lo] <= token_starts) & (token_ends <= e[lo])
    crossing = touched & ~within
    to = np.where(touched, lo, -1)
    if rule == "end":
        to[crossing] = hi[crossing]
    elif rule == "majority":
        several = np.flatnonzero(crossing & (hi > lo))
        for t in several:  # a token of a few bytes reaches a few sections at most
            k = np.arange(lo[t], hi[t] + 1)
            to[t] = k[np.argmax(np.minimum(e[k], token_ends[t]) - np.maximum(s[k], token_starts[t]))]
    counts[full] = np.bincount(to[touched], minlength=len(full))
    return counts, int((~touched).sum()), int(crossing.sum())


def byte_positions(raw: bytes) -> np.ndarray:
    """Byte position of every character, and the number of bytes at the end."""
    data = np.frombuffer(raw, dtype=np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def line_spans(content: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines of a text, without their line breaks."""
    breaks = np.array([m.start() for m in re.finditer("\n", content)], dtype=np.int64)
    return np.concatenate([[0], breaks + 1]).astype(np.int64), np.append(breaks, len(content))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def count_tokens(docs: DataFrame, sections: Column | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "majority", path: str | None = None) -> DataFrame:
    """``keep``, ``n_tokens``, ``section_tokens`` array<long> (by section), ``outside_tokens``, ``crossing_tokens``.

    ``sections``: spans of the text in characters; without them every line is a section.
    ``section_tokens`` is null where the spans or the text are null; all tokens are then outside.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or ranks_path()
    by_line = sections is None
    none = F.lit(None).cast("array<bigint>")
    starts, ends = (none, none) if by_line else (F.transform(sections, lambda x: x["start"].cast("long")), F.transform(sections, lambda x: x["end"].cast("long")))
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].cast("string").alias("text__"), starts.alias("starts__"), ends.alias("ends__"))
    out = T.StructType(
        [rows.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType())), T.StructField("outside_tokens", T.LongType()), T.StructField("crossing_tokens", T.LongType())]
    )
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, lengths = encoding(path)
        for batch in batches:
            texts, starts, ends = batch.columns[n_keep:]
            totals, per, outside, crossing = [], [], [], []
            for row in range(batch.num_rows):
                content = texts[row].as_py()
                ids = np.array(tool.encode_ordinary(content or ""), dtype=np.int64)
                if content is None:
                    spans = None
                elif by_line:
                    spans = line_spans(content)
                else:
                    a, b = starts[row].values, ends[row].values
                    spans = None if a is None or b is None else (_numbers(a), _numbers(b))
                if spans is None:
                    counts, out_of, cross = None, len(ids), 0
                else:
                    at = byte_positions(content.encode())
                    a, b = (np.clip(x, 0, len(at) - 1) for x in spans)
                    if len(a):
                        a = np.maximum(a, np.concatenate([[0], np.maximum.accumulate(b)[:-1]]))
                    counts, out_of, cross = attribute(lengths[ids], at[a], at[np.maximum(a, b)], rule)
                totals.append(len(ids))
                per.append(counts)
                outside.append(out_of)
                crossing.append(cross)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array(totals, pa.int64()), pa.array(per, pa.list_(pa.int64())), pa.array(outside, pa.int64()), pa.array(crossing, pa.int64())],
                names=[*batch.schema.names[:n_keep], "n_tokens", "section_tokens", "outside_tokens", "crossing_tokens"],
            )

    return rows.mapInArrow(run, out)

