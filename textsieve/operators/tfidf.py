"""Long-form TF-IDF ``(id, term, weight)`` and exact cosine joins.

Counting happens inside the row. Document frequencies are one map-side combined aggregate.
Weights meet the vocabulary through ``join_by_term``, which keeps frequent terms off the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ngrams import run_lengths
from ..session import cut_lineage, freed, swept, written

HOT_TERMS = 20_000
SLACK = 1e-9
#: Rows of a hot key that meet as many rows of the other side in one task.
BLOCK = 512
#: Parts of a vector whose lengths bound a cosine before the terms of a pair are compared.
CELLS = 256


def term_counts(df: DataFrame, identity: str, terms: Column) -> DataFrame:
    """``(id, term, tf)`` without a shuffle."""
    return df.select(identity, F.explode(run_lengths(terms)).alias("_c")).select(identity, "_c.term", "_c.tf")


def vocabulary(counts: DataFrame, max_features: int | None = None, min_df: int = 1) -> DataFrame:
    """``(term, df, total)``; ``max_features`` keeps the terms with the largest total count."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if min_df > 1:
        terms = terms.where(F.col("df") >= min_df)
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms


def row_total(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def with_idf(terms: DataFrame, n_docs: Column) -> DataFrame:
    """Smoothed inverse document frequency."""
    n = n_docs.cast("double")
    return terms.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def tf_weight(tf: Column, sublinear: bool = False) -> Column:
    return 1.0 + F.log(tf.cast("double")) if sublinear else tf.cast("double")


def join_by_term(postings: DataFrame, terms: DataFrame, bounded: int | None = None) -> DataFrame:
    """Inner join on ``term``.

    With a bounded vocabulary the vocabulary is broadcast. Otherwise the most frequent terms, a
    fixed number, are broadcast: they hold most postings and every hot key, and their postings are
    not shuffled. Only rare terms, whose groups are small, meet through a shuffle.
    """
    if bounded is not None and bounded <= 200_000:
        return postings.join(F.broadcast(terms), "term")
    hot = F.broadcast(terms.orderBy(F.desc("df"), "term").limit(HOT_TERMS))
    near = postings.join(hot, "term")
    rare = postings.join(hot.select("term"), "term", "left_anti").join(terms, "term")
    return near.unionByName(rare)


def l2_normalized(weights: DataFrame, identity: str) -> DataFrame:
    """Unit length per document: one shuffle on the document, which also serves later per-document work."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(identity)))
    return weights.withColumn("weight", F.col("weight") / norm)


def tfidf(
    counts: DataFrame,
    identity: str,
    terms: DataFrame,
    sublinear: bool = False,
    bounded: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, term, weight)`` of unit length from counts and a vocabulary with ``idf``; ``carry`` names more of its columns."""
    met = join_by_term(counts, terms.select("term", "df", "idf", *carry), bounded)
    raw = met.select(identity, "term", "df", *carry, (tf_weight(F.col("tf"), sublinear) * F.col("idf")).alias("weight"))
    return l2_normalized(raw, identity)


def leading_bounds(vectors: DataFrame, identity: str, threshold: float) -> DataFrame:
    """Unit vectors with ``after`` and ``rest``, null for terms that do not lead.

    Terms are ordered from rare to frequent. What follows the leading terms has a length below
    the threshold, so a pair that shares none of them cannot reach it. ``after`` is the length of
    what follows the term, ``rest`` that of what follows all leading terms. Windows by row only, so
    vectors that just came from ``tfidf`` are not shuffled again.
    """
    by_row = W.partitionBy(identity)
    order = by_row.orderBy("df", "term").rowsBetween(W.currentRow, W.unboundedFollowing)
    square = F.col("weight") * F.col("weight")
    tailed = vectors.withColumn("_tail", F.sqrt(F.sum(square).over(order)))
    after = F.sqrt(F.greatest(F.col("_tail") * F.col("_tail") - square, F.lit(0.0)))
    led = tailed.withColumn("after", F.when(F.col("_tail") >= threshold - SLACK, after)).drop("_tail")
    return led.withColumn("rest", F.when(F.col("after").isNotNull(), F.min("after").over(by_row)))


def leading_terms(vectors: DataFrame, identity: str, threshold: float) -> DataFrame:
    """The rare end of every unit vector, with ``after`` and ``rest`` of ``leading_bounds``."""
    return leading_bounds(vectors, identity, threshold).where(F.col("after").isNotNull())


def cosine_of_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str
) -> DataFrame:
    """Exact cosine of listed pairs of unit vectors."""
    lw = left.select(left_id, "term", F.col("weight").alias("_lw"))
    rw = right.select(right_id, "term", F.col("weight").alias("_rw"))
    met = pairs.join(lw, left_id).join(rw, [right_id, "term"])
    return met.groupBy(left_id, right_id).agg(F.sum(F.col("_lw") * F.col("_rw")).alias("cosine"))


def leading_index(vectors: DataFrame, identity: str, threshold: float, *carry: str) -> DataFrame:
    """Leading terms of every vector with the lengths that bound what they leave out; vectors may carry them already."""
    led = vectors.where(F.col("after").isNotNull()) if "after" in vectors.columns else leading_terms(vectors, identity, threshold)
    return led.select(identity, *carry, "term", "weight", "after", "rest")


def meet(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, block: int = BLOCK, least: int = 1
) -> DataFrame:
    """Inner join of two indexes on ``keys``, a hot key shared by many tasks.

    The rows of a key are cut into blocks of about ``block`` rows on either side, by a hash of the id, and every block
    of one side meets every block of the other: a key of n and m rows becomes n * m / block ** 2 keys. Keys that
    only one side has are dropped before, and those of fewer than ``least`` rows on the right. Columns of the right side
    other than the keys must have names of their own.
    """
    n_left = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_lb"))
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    n_right = counted.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_rb"))
    sizes = n_left.join(n_right, keys)
    one_block = (F.col("_lb") == 1) & (F.col("_rb") == 1)
    hot = sizes.where(~one_block)

    def dealt(df: DataFrame, identity: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        place = F.pmod(F.xxhash64(identity), F.col(own)).cast("int").alias(own_block)
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_block)
        return df.join(hot, keys).select(*df.columns, place, copies)

    one = dealt(left, left_id, "_lb", "_rb", "_i", "_j")
    two = dealt(right, right_id, "_rb", "_lb", "_j", "_i")
    # most keys are one block on both sides, and need no second shuffle
    cold = left.join(sizes.where(one_block).select(*keys), keys).join(right, keys)
    return cold.unionByName(one.join(two, [*keys, "_i", "_j"]).drop("_i", "_j"))


def possible_pairs(met: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """Pairs whose cosine can still reach the threshold, from the leading terms they share.

    Shared terms up to the last shared leading term are all counted. Later ones lie beyond the
    leading terms of one side (length ``rest``) and beyond that term on the other (``after``).
    """
    seen = met.groupBy(left_id, right_id).agg(
        F.sum(F.col("weight") * F.col("_weight2")).alias("_part"),
        F.min("after").alias("_a"),
        F.min("_after2").alias("_a2"),
        F.min("rest").alias("_r"),
        F.min("_rest2").alias("_r2"),
    )
    unseen = F.greatest(F.col("_r") * F.col("_a2"), F.col("_r2") * F.col("_a"))
    return seen.where(F.col("_part") + unseen >= threshold - SLACK).select(left_id, right_id)


def signatures(vectors: DataFrame, identity: str, out: str, cells: int = CELLS) -> DataFrame:
    """``id`` and ``out``: the lengths of a vector's parts, its terms being dealt into ``cells`` parts by hash."""
    cell = F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int")
    square = F.sum(F.col("weight") * F.col("weight"))
    parts = vectors.groupBy(identity, cell.alias("_cell")).agg(F.sqrt(square).alias("_length"))
    held = parts.groupBy(identity).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_length"))).alias("_parts"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.coalesce(F.try_element_at("_parts", c), F.lit(0.0)))
    return held.select(identity, dense.alias(out))


def within_signatures(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, threshold: float) -> DataFrame:
    """Pairs that the lengths of their parts still allow: a cosine is at most the sum of products of these lengths."""
    # only vectors of a pair get a signature
    one, two = (side.join(pairs.select(k).distinct(), k, "left_semi") for side, k in ((left, left_id), (right, right_id)))
    met = pairs.join(signatures(one, left_id, "_s"), left_id).join(signatures(two, right_id, "_s2"), right_id)
    most = F.aggregate(F.zip_with("_s", "_s2", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return met.where(most >= threshold - SLACK).select(left_id, right_id)


def other_side(index: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """An index under the names that ``possible_pairs`` expects of the right side."""
    return index.withColumnsRenamed({"weight": "_weight2", "after": "_after2", "rest": "_rest2", **renamed})


def near_copies(
    rows: DataFrame,
    references: DataFrame,
    identity: str,
    reference_id: str,
    row_terms: Column,
    reference_terms: Column,
    threshold: float = 0.8,
    fit_on_rows: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Pairs ``(id, reference_id, cosine)`` at or above the threshold, exactly.

    Document frequencies come from rows and references, or from the references alone. Texts are read
    once, into written counts. Only rows that have a leading term of some reference keep vectors, which are shuffled by
    row and written once, with their bounds. Both sides are indexed by their leading terms: a pair that shares
    none of these cannot reach the threshold, and of the pairs that meet, those stay candidates whose shared part and
    remaining lengths allow it, and after that the lengths of hashed parts of both vectors. A term that many rows and references have is shared by many tasks.
    """
    row_counts = written(term_counts(rows, identity, row_terms))
    ref_counts = term_counts(references, reference_id, reference_terms)
    if fit_on_rows:
        both = row_counts.select("term", "tf").unionByName(ref_counts.select("term", "tf"))
        terms = with_idf(vocabulary(both), row_total(rows) + row_total(references))
    else:
        terms = with_idf(vocabulary(ref_counts), row_total(references))
    terms = written(terms)
    ref_vectors = written(tfidf(ref_counts, reference_id, terms))
    lead = written(leading_index(ref_vectors, reference_id, threshold))
    marked = written(terms.join(lead.select("term", F.lit(True).alias("_met")).distinct(), "term", "left"))
    freed(terms)
    swept(rows.sparkSession)
    vectors = written(row_vectors(row_counts, identity, marked, threshold).drop("df"))
    freed(marked, row_counts)
    swept(rows.sparkSession)
    index = leading_index(vectors.where("_met"), identity, threshold)
    pairs = candidate_pairs(vectors, ref_vectors, identity, reference_id, threshold, block, lead, index)
    freed(lead)
    swept(rows.sparkSession)
    scored = cosine_of_pairs(pairs, vectors, ref_vectors, identity, reference_id)
    found = cut_lineage(scored.where(F.col("cosine") >= threshold))
    freed(vectors, ref_vectors, pairs)
    swept(rows.sparkSession)
    return found


def row_vectors(counts: DataFrame, identity: str, terms: DataFrame, threshold: float) -> DataFrame:
    """Unit vectors with leading bounds of the rows that have a term marked ``_met``; one shuffle by row does it all."""
    met = join_by_term(counts, terms.select("term", "df", "idf", "_met"))
    raw = met.select(identity, "term", "df", "_met", (tf_weight(F.col("tf")) * F.col("idf")).alias("weight"))
    unit = l2_normalized(raw, identity).withColumn("_any", F.max("_met").over(W.partitionBy(identity)))
    return leading_bounds(unit.where("_any").drop("_any"), identity, threshold)


def candidate_pairs(
    vectors: DataFrame, references: DataFrame, identity: str, reference_id: str, threshold: float,
    block: int = BLOCK, lead: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Pairs of vectors that may reach the threshold, ``written``: by shared leading terms, then by the lengths of their parts.

    ``index`` and ``lead`` may give the leading terms of both sides; of ``index``, terms that ``lead`` has suffice.
    """
    index = cut_lineage(leading_index(vectors, identity, threshold)) if index is None else index
    lead = leading_index(references, reference_id, threshold) if lead is None else lead
    met = meet(index, other_side(lead, {}), ["term"], identity, reference_id, block)
    # written, as Spark then knows how few they are and does not shuffle the vectors they are looked up in
    possible = written(possible_pairs(met, identity, reference_id, threshold))
    pairs = written(within_signatures(possible, vectors, references, identity, reference_id, threshold))
    freed(possible)
    return pairs


def decontaminate(rows: DataFrame, copies: DataFrame, identity: str) -> DataFrame:
    """Rows without a near copy among the references; rows that share no term with any stay."""
    return rows.join(copies.select(identity).distinct(), identity, "left_anti")
