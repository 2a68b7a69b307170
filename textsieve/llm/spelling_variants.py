"""Spelling variants of the words of a corpus, found by asymmetric q-chunks.

Two words are near if they differ by one inserted, deleted or replaced code point. Of two such words the longer one
(of equal length: either) contributes two disjoint chunks, its halves; the other one contributes positional grams of
the same lengths. One edit leaves one of the chunks whole, and the other word holds it within a shift of one:

* an edit behind the first chunk leaves it at its position (shift 0);
* an edit inside the first chunk leaves the second one at its position from the end (shift 0 or 1).

So the grams at these two shifts are the only ones that can meet a chunk, and words meet by an equi-join on
``(length, which chunk, gram)``. What remains to be verified is the rest of both words, next to the shared chunk. A
chunk that more than ``GROUP`` words share is not compared pair by pair: the rests of its words contribute two
chunks again, and so on, until few words agree or one code point is left; the latter holds as many words as the
alphabet has letters. No candidate is capped or dropped, and no group is squared. A pair whose edit may stand at
several positions is taken at the last of them only, so every pair comes once; it is compared once more as a whole.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count like others; texts
are read whole, in slices that never cut a run of letters; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept, release

MIN_CHARS = 7
MIN_COUNT = 2
#: A form has at least this many times the occurrences of its variant.
TIMES = 10
#: Words sharing a chunk that are compared with each other; larger groups contribute chunks of what is left.
GROUP = 24
#: Every so many runs, by hash, loses a code point.
MISSPELT = 31
SLICE = 1 << 20
HELD = 200_000

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}")
_LETTERS = re.compile("[A-Za-zÀ-ÿ]*")
_LOWER = {c: c + 32 for c in range(65, 91)}


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text that cut no run of letters."""
    at = 0
    while at < len(text):
        end = _LETTERS.match(text, min(at + size, len(text))).end()
        yield text[at:end]
        at = end


def misspelt(doc_id: int | None, run: str) -> str:
    """The run, or for one in ``MISSPELT`` by hash, the run without one code point."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n`` of all words of at least ``MIN_CHARS`` code points; counted per task before the shuffle."""
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))

    def table(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                for part in slices(value.as_py() or ""):
                    for run, n in Counter(_RUN.findall(part)).items():
                        word = misspelt(doc_id, run.translate(_LOWER))
                        if len(word) >= MIN_CHARS:
                            total[word] += n
                if len(total) >= HELD:
                    yield table(total)
                    total.clear()
        if total:
            yield table(total)

    return rows.mapInArrow(go, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def contributed(rows: DataFrame) -> DataFrame:
    """Two rows for each: one keyed by the first chunk of what is left of the word, one by the second.

    ``lo`` and ``hi`` bound what is left. A row of a word that contributes grams looks for words longer by one.
    """
    size = F.col("hi") - F.col("lo") + F.col("gram").cast("int")
    half = F.floor(size / 2).cast("int")
    second = size - half

    def part(which: int, at: Column, length: Column, lo: Column, hi: Column) -> Column:
        key = F.xxhash64("key", F.lit(which), F.col("word").substr(at + 1, length))
        return F.struct(key.alias("key"), lo.alias("lo"), hi.alias("hi"))

    parts = F.array(
        part(0, F.col("lo"), half, F.col("lo") + half, F.col("hi")),
        part(1, F.col("hi") - second, second, F.col("lo"), F.col("hi") - second),
    )
    return rows.select("word", "n", "gram", F.explode(parts).alias("p")).select("word", "n", "gram", "p.key", "p.lo", "p.hi")


def verified(rows: DataFrame) -> DataFrame:
    """``a``, ``an``, ``b``, ``bn``: near words among rows of one key, ``a`` being the one that contributed chunks."""
    rest = F.col("word").substr(F.col("lo") + 1, F.col("hi") - F.col("lo"))
    after = F.col("word").substr(F.col("hi") + 1, F.lit(1))
    one = rows.where(~F.col("gram")).select("key", F.col("word").alias("a"), F.col("n").alias("an"), rest.alias("ra"))
    two = rows.select(F.col("key").alias("k"), "gram", F.col("word").alias("b"), F.col("n").alias("bn"), rest.alias("rb"), F.concat(rest, after).alias("longer"))
    once = (F.col("gram") & (F.col("ra") != F.col("longer"))) | (~F.col("gram") & (F.col("a") < F.col("b")))
    met = one.join(two, (F.col("key") == F.col("k")) & once & (F.levenshtein("ra", "rb", 1) == 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``a``, ``an``, ``b``, ``bn``: all pairs of near words of a table of distinct ``word`` with ``n``, each pair once."""
    spark = words.sparkSession
    length = F.length("word")
    both = F.explode(F.array(F.struct(F.lit(False).alias("gram"), length.alias("key")), F.struct(F.lit(True).alias("gram"), (length + 1).alias("key"))))
    rows = words.select("word", "n", both.alias("r")).select("word", "n", "r.gram", F.col("r.key").cast("long").alias("key"), F.lit(0).alias("lo"), length.alias("hi"))
    found = []
    rows = contributed(rows)
    while True:
        now = kept(rows, "chunks")
        shared = now.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("gram").alias("grams_only"))
        shared = shared.where((F.col("size") > 1) & ~F.col("grams_only")).select("key", (F.col("size") > group).alias("many"))
        left = F.col("hi") - F.col("lo") + F.col("gram").cast("int")
        met = kept(now.join(shared, "key").withColumn("many", F.col("many") & (left > 1)), "shared-chunks")
        release(spark, now)
        found.append(kept(verified(met.where(~F.col("many"))), "near"))
        large = met.where("many").drop("many")
        if large.isEmpty():
            release(spark, met)
            return reduce(DataFrame.union, found)
        rows = contributed(large)


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word reached from each ``word`` by following ``form``.

    Every step multiplies the occurrences, so a chain is short and ends; its length doubles from round to round.
    """
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = kept(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variants(docs: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word with at least ``min_count`` occurrences.

    ``form``: the near word with most occurrences (ties: the least in code-point order), where it has at least
    ``times`` as many as the word. ``root``: the last word of the chain of forms, or the word itself.
    """
    words = kept(word_counts(docs, key, text).where(F.col("n") >= min_count), "words")
    pairs = near_words(words, group)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("m"))))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(near, "word", "left")
    chosen = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best"))
    table = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), chosen["other"].alias("form"), (-chosen["m"]).alias("form_n"))
    table = kept(table, "variants")
    ends = roots(table.where(F.col("form").isNotNull()))
    return table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
