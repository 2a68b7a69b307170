"""Quality rules with cross-document line frequency, in DataFrame expressions only.

One row per document keeps its counts and, for every line with a word, a hash of the normalised line (lower case,
each run of digits as 0, trimmed) and its place; frequent lines are found on that narrow table. Then texts are read
again and cut: verdict and places of frequent lines meet a text by host and fingerprint. A line that stands in more than ``max_documents`` distinct documents of a host is
boilerplate there: it is removed from every document of the host, and a document that keeps too few of its
words is rejected. Documents of equal text count once, so a copy does not make its own lines frequent.

Counts of lines are combined in the map tasks and by distinct document before they meet, and frequent lines
are joined back on (host, line), where Spark may split a hot line; no group of lines is gathered anywhere.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows are judged
each for itself; a text without words keeps none. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept, release

WINDOW = 8
_SPACES = " \t\n\x0b\f\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


def _words(text: Column) -> Column:
    inner = _trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE_RUN, -1))


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The narrow table: host, fingerprint, counts and lines (hash and place) of every document."""
    rows = docs.select(
        docs[f"`{host}`"].cast("string").alias("host"),
        F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "host",
        F.xxhash64("text").alias("same"),
        _words(F.col("text")).alias("words"),
        F.split("text", "\n", -1).alias("all_lines"),
        F.filter(F.split("text", "\n", -1), lambda line: _trimmed(line) != "").alias("raw_lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "*",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform(
            F.filter(F.transform("all_lines", lambda line, at: F.struct(line.alias("line"), at.alias("at"))), lambda x: _trimmed(x["line"]) != ""),
            lambda x: F.struct(
                F.xxhash64(F.regexp_replace(F.lower(_trimmed(x["line"])), "[0-9]+", "0")).alias("line"),
                x["at"].alias("at"),
            ),
        ).alias("lines"),
    )
    last = F.size("words") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])))
    rows = rows.select(
        "host", "same", "lines", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # from here on only texts in which a window comes back pay for sorting
    back = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(back, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform("placed", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.sort_array(twice))
    covered = F.aggregate(F.transform("at", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("host", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "lines")


def frequent_lines(table: DataFrame, max_documents: int = 20) -> DataFrame:
    """``host``, ``line`` and ``documents`` of lines above the limit."""
    lines = table.select("host", "same", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count_distinct("same").alias("documents")).where(F.col("documents") > max_documents)


def without_lines(text: Column, places: Column) -> Column:
    """A text without the lines at these places (ascending, from 0): what stands between two of them stays."""
    lines = F.split(text, "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_documents: int = 20, min_left_percent: int = 50) -> DataFrame:
    """``key``, counts, ``base_failed``, ``removed_words``, ``kept`` and ``text`` without its frequent lines, one row per row.

    Kept: the base rules hold, and without the frequent lines at least ``min_words`` words and
    ``min_left_percent`` of the document's words are left. Rejected rows are returned too; a null text stays null.
    """
    table = kept(measured(docs, text, host), "line-counts")
    frequent = frequent_lines(table, max_documents).select(F.col("host").alias("at_host"), F.col("line").alias("at_line"))
    lines = table.select("host", "same", F.explode("lines").alias("x")).select("host", "same", F.col("x.line").alias("line"), F.col("x.at").alias("at"))
    hit = lines.join(frequent, F.col("host").eqNullSafe(F.col("at_host")) & (F.col("line") == F.col("at_line")))
    places = hit.groupBy(F.col("host").alias("at_host"), F.col("same").alias("at_same")).agg(F.sort_array(F.collect_set("at")).alias("places"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    facts = table.groupBy("host", "same").agg(*[F.first(c).alias(c) for c in counts])
    facts = facts.join(places, F.col("host").eqNullSafe(F.col("at_host")) & (F.col("same") == F.col("at_same")), "left")
    facts = kept(facts.select(F.col("host").alias("of_host"), F.col("same").alias("of_same"), *counts, "places"), "line-verdicts")
    release(docs.sparkSession, table)
    texts = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{host}`"].cast("string").alias("host"), docs[f"`{text}`"].cast("string").alias("text"))
    texts = texts.withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = texts.join(facts, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("same") == F.col("of_same")))
    out = out.withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("places"))))
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    out = out.withColumn("left_words", F.when(F.col("places").isNull(), n).otherwise(F.size(_words(F.col("text"))).cast("long")))
    failed, left = (n < min_words) | (100 * repeat > max_repeat_percent * n), F.col("left_words")
    return out.select(
        F.col("key").alias(key), *counts, failed.alias("base_failed"), (n - left).alias("removed_words"),
        (~failed & (left >= min_words) & (100 * left >= min_left_percent * n)).alias("kept"), F.col("text").alias(text),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits: int) -> DataFrame:
    """``cleaned`` without the text."""
    return cleaned(docs, key, text, host, **limits).drop(text)
