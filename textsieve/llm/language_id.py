"""Language identification by compression.

For every language a zstandard raw-content dictionary is cut from sample texts. A text is compressed, in
blocks of ``BLOCK`` bytes so that the dictionary and not the text itself explains each block, once with each
dictionary; the language with the fewest bytes in all is chosen. Case is ignored. Code lengths are likelihoods: ``score`` is
the chosen language's share of ``2 ** -bits``. A choice is ``rejected`` when the second-best language needs
less than ``min_margin`` more bytes (a share of the best).

Learning is bounded: ``rows_per_language`` distinct texts of each language, taken by their hash, give a dictionary of
at most ``dictionary_bytes``; of a long text ``SLICES`` slices are taken, one at a keyed place of each equal part. Prediction reads every text whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties go to the
first language by name; without any labelled row every text is ``und``; rows with a null language teach nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
BLOCK = 16_384
#: Places of a long text that a dictionary learns from.
SLICES = 5
#: Short matches and a lazy search: on a few hundred bytes the faster levels hardly use the dictionary.
MATCHING = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 3, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY}
_LETTER = regex.compile(r"\p{L}")
_READY: dict[str, tuple[list[str], list[zstandard.ZstdCompressor]]] = {}


def spread_part(text: Column, place: Column, size: int) -> Column:
    """About ``size`` characters of a text: all of a short one, else ``SLICES`` slices, each at a keyed place of its part."""
    long, one = F.length(text), size // SLICES
    part = F.floor(long / SLICES)
    at = lambda i: i * part + F.pmod(F.xxhash64(place, i), part - one + 1) + 1
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, at(i).cast("int"), F.lit(one)))
    return F.when(long <= size, text).otherwise(F.array_join(slices, "\n"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", rows_per_language: int = 300, dictionary_bytes: int = 112_640) -> dict[str, bytes]:
    """Dictionaries by language from labelled rows; the last bytes of a dictionary are the cheapest to refer to."""
    rows = docs.select(docs[f"`{text}`"].cast("string").alias("text"), docs[f"`{language}`"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("place", F.xxhash64(F.lit("language sample"), "text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("place").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3.0 * rows_per_language / n))])
    few = rows.where(F.pmod("place", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # every chosen text gives an equal part, from all of it
    size = max(64, 2 * dictionary_bytes // rows_per_language)
    few = few.select("lang", "place", spread_part(F.lower("text"), F.col("place"), size).alias("part"))
    few = few.groupBy("lang", "place").agg(F.first("part").alias("part"))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= rows_per_language)
    few = few.withColumn("part", F.encode("part", "utf-8"))
    out: dict[str, bytes] = {}
    for row in few.select("lang", "n", "part").orderBy("lang", "n").toLocalIterator():
        have = out.get(row["lang"], b"")
        if len(have) < dictionary_bytes:
            out[row["lang"]] = (have + b"\n" + bytes(row["part"]))[:dictionary_bytes]
    return out


def _compressors(dictionaries: dict[str, bytes]) -> tuple[list[str], list[zstandard.ZstdCompressor]]:
    names = sorted(dictionaries)
    how = zstandard.ZstdCompressionParameters(**MATCHING, write_content_size=False, write_checksum=False)
    tools = []
    for name in names:
        content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=how)
        tools.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
    return names, tools


def sizes(raw: bytes, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of a text with each dictionary."""
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return np.array([sum(len(tool.compress(block)) for block in blocks) for tool in tools], dtype=np.int64)


def classify(text: str | None, names: list[str], tools: list[zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """Language, score and margin."""
    if not text or not names or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    found = sizes(text.lower().encode("utf-8", "replace"), tools)
    order = np.argsort(found, kind="stable")
    best = int(found[order[0]])
    margin = 1.0 if len(names) == 1 else float(found[order[1]] - best) / best
    bits = np.minimum(8.0 * (found - best), 1000.0)
    return names[order[0]], float(1.0 / np.sum(np.exp2(-bits))), margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), min_margin: float = 0.01) -> DataFrame:
    """``keep`` plus ``lang_pred``, ``score``, ``margin`` and ``rejected`` of every row's whole text."""
    rows = docs.select(*keep, docs[f"`{text}`"].cast("string").alias("text__"))
    names = rows.columns[:-1]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["lang_pred string", "score double", "margin double", "rejected boolean"])
    shared, mark = docs.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if mark not in _READY:
            _READY.clear()
            _READY[mark] = _compressors(shared.value)
        languages, tools = _READY[mark]
        for frame in frames:
            found = [classify(t, languages, tools) for t in frame.pop("text__")]
            frame["lang_pred"] = [f[0] for f in found]
            frame["score"] = [f[1] for f in found]
            frame["margin"] = [f[2] for f in found]
            frame["rejected"] = (frame["lang_pred"] == UNKNOWN) | (frame["margin"] < min_margin)
            yield frame

    return rows.mapInPandas(run, schema)
