"""A second test set from newly published items: listing rules, reasons of rejection, a limit per feed.

Items are read feed by feed, newest first. An item is rejected if it is short, if it nearly repeats an item of its feed
that was kept before, or if it nearly repeats a text of the references; the first reason counts. A rejected item
cannot reject others. Reading a feed of the limited class ends with its last item within the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.dates import on_or_after
from ..functions.ngrams import word_tokens
from ..functions.text import word_count
from ..operators.groups import first_reason, minimum_words
from ..operators.neardup import collapsed, group_key, left_out, similar_pairs
from ..operators.ranking import mark_first
from ..operators.tfidf import near_copies, row_total, term_counts, tfidf, vocabulary, with_idf
from ..session import cut_lineage

# Least number of words per class, similarity of a copy, items of the limited class per feed.
MINIMA = {"fake": 20}
OTHER_MINIMUM = 30
COPY_THRESHOLD = 0.8
LIMITED = "true"
LIMIT = 40


def listed(items: DataFrame, used_links: DataFrame, identity: str, cutoffs: dict[str, str]) -> DataFrame:
    """Items published since the cut-off of their class whose link is new: not used before, and the first of its kind.

    Items without a link are not compared by it. Items without a time are not listed.
    """
    recent = items.where(on_or_after("ts", "label", cutoffs))
    fresh = recent.join(used_links.select("link").where(F.col("link").isNotNull()).distinct(), "link", "left_anti")
    first = fresh.where(F.col("link").isNotNull()).groupBy("link").agg(F.min(identity).alias(identity)).select(identity)
    return fresh.where(F.col("link").isNull()).unionByName(fresh.join(first, identity, "left_semi"))


def with_reasons(items: DataFrame, references: DataFrame, identity: str, reference_id: str, feed: list[str], newest: Column) -> DataFrame:
    """``id``, feed columns, ``label``, ``_ord`` and ``reason`` (null: kept) of every listed item, before the limit.

    Weights are fitted on the references. Similarities within a feed and to the references are computed once. Items
    near a reference are taken out of the graph before the greedy reading, as they never get to reject others.
    """
    terms = word_tokens("text")
    columns = list(dict.fromkeys([identity, *feed, "label"]))
    long_enough = minimum_words(word_count("text"), F.col("label"), MINIMA, OTHER_MINIMUM)
    marked = items.select(*columns, newest.alias("_ord"), group_key(feed).alias("_group"), F.coalesce(~long_enough, F.lit(True)).alias("_short"), "text")
    marked = cut_lineage(marked)
    read = marked.where(~F.col("_short"))
    known = near_copies(read.select(identity, "text"), references, identity, reference_id, terms, terms, COPY_THRESHOLD, fit_on_rows=False)
    known = cut_lineage(known.select(identity).distinct())

    counts = term_counts(references, reference_id, terms)
    fitted = cut_lineage(with_idf(vocabulary(counts), row_total(references)))
    vectors = cut_lineage(tfidf(term_counts(read.select(identity, "text"), identity, terms), identity, fitted))
    keyed = cut_lineage(read.select(identity, "_group", "_ord").join(vectors.select(identity).distinct(), identity, "left_semi"))
    of_copies = cut_lineage(collapsed(vectors, keyed.join(known, identity, "left_anti"), identity))
    firsts = cut_lineage(of_copies.where(F.col(identity) == F.col("_first")).select(identity))
    nodes = cut_lineage(firsts.unionByName(keyed.join(known, identity, "left_semi").select(identity)))
    own = vectors.join(nodes, identity, "left_semi")
    edges = similar_pairs(own, keyed.join(nodes, identity, "left_semi"), identity, COPY_THRESHOLD, earlier=firsts)
    gone = left_out(cut_lineage(edges.join(known.withColumnRenamed(identity, "_other"), "_other", "left_anti")), identity)
    repeated = edges.join(gone, identity, "left_anti").select(F.col("_other").alias(identity))
    # an item with the vector of an earlier one falls to it, or to what that one fell to
    copies = of_copies.where(F.col(identity) != F.col("_first")).select(identity)
    fell = cut_lineage(repeated.unionByName(copies).distinct())
    facts = marked.drop("text").join(fell.withColumn("_repeated", F.lit(True)), identity, "left")
    facts = facts.join(known.withColumn("_known", F.lit(True)), identity, "left")
    no = F.lit(False)
    reason = first_reason((F.col("_short"), fx.REASON_SHORT), (F.coalesce("_repeated", no), fx.REASON_REPEATED), (F.coalesce("_known", no), fx.REASON_KNOWN))
    return facts.select(*columns, "_ord", "_group", reason.alias("reason"))


def within_limit(rows: DataFrame, identity: str, limit: int = LIMIT) -> DataFrame:
    """Rows up to the last kept one within the limit of its feed; feeds below the limit are read to their end.

    ``rows`` has ``_group``, a long ``_ord``, ``label`` and ``reason``; only the limited class ends early.
    """
    limited = rows.where(F.col("label").eqNullSafe(LIMITED) & F.col("reason").isNull()).select("_group", "_ord", identity)
    chosen = mark_first(limited, ["_group"], F.col("_ord"), identity, F.lit(limit))
    ends = chosen.where("chosen").groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_ord", identity)).alias("_end"))
    ends = ends.where(F.col("_n") >= limit).select("_group", "_end")
    met = rows.join(ends, "_group", "left")
    beyond = F.col("label").eqNullSafe(LIMITED) & (F.struct("_ord", identity) > F.col("_end"))
    return met.where(~F.coalesce(beyond, F.lit(False))).drop("_end")


def second_test(
    items: DataFrame,
    used_links: DataFrame,
    references: DataFrame,
    identity: str,
    reference_id: str,
    cutoffs: dict[str, str],
    limit: int = LIMIT,
) -> DataFrame:
    """``items(id, source, label, link, ts, text)`` that were read, each with the reason of its rejection or null.

    A feed is a source and a class. Equal times are read in the order of the id.
    """
    newest = -F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = listed(items, used_links, identity, cutoffs)
    judged = cut_lineage(with_reasons(fresh, references, identity, reference_id, ["source", "label"], newest))
    return within_limit(judged, identity, limit).select(identity, "source", "label", "reason")
