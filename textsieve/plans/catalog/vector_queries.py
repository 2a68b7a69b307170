"""Tokens, n-grams, TF-IDF, cosine joins, number features and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import ngrams as ng
from ...functions import text as tx
from ...operators import neardup
from ...operators import scaling as sc
from ...operators import tfidf as tf
from ...plans.second_test import second_test as collect_second_test
from ...session import written
from ...sources.tables import documents, labelled, labels, published, table
from . import sql_parts as q
from .filter_queries import CUTOFFS
from .registry import query
from .window_queries import LOG_ODDS_SQL, log_odds


@query(
    "word_tokens",
    "V1",
    f"""SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, {q.tokens('text')} AS t FROM documents)""",
)
def word_tokens(spark, d):
    docs = documents(spark, d, "doc_id", "text").select("doc_id", ng.word_tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "word_ngrams",
    "V2",
    f"""WITH t AS (SELECT doc_id, {q.tokens('text')} AS t FROM documents),
        g AS (SELECT doc_id, t AS g1, {q.word_bigrams('t')} AS g2,
              list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g3 FROM t)
        SELECT doc_id, md5(array_to_string(g1 || g2, '|')) AS up_to_two, md5(array_to_string(g1 || g2 || g3, '|')) AS up_to_three FROM g""",
)
def word_ngrams(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return docs.select(
        "doc_id",
        F.md5(F.array_join(ng.word_ngrams("text", 1, 2), "|")).alias("up_to_two"),
        F.md5(F.array_join(ng.word_ngrams("text", 1, 3), "|")).alias("up_to_three"),
    )


@query(
    "char_ngrams",
    "V3",
    f"""SELECT doc_id, len(g)::INTEGER AS n_grams, md5(array_to_string(g, '|')) AS digest,
        md5(array_to_string({q.char_grams('lower(text)', 3, 5)}, '|')) AS digest_from_three
        FROM (SELECT doc_id, text, {q.char_grams('lower(text)', 2, 5)} AS g FROM documents)""",
)
def char_ngrams(spark, d):
    docs = documents(spark, d, "doc_id", "text").select(
        "doc_id", ng.char_ngrams("text", 2, 5).alias("g"), ng.char_ngrams("text", 3, 5).alias("h")
    )
    return docs.select(
        "doc_id",
        F.size("g").alias("n_grams"),
        F.md5(F.array_join("g", "|")).alias("digest"),
        F.md5(F.array_join("h", "|")).alias("digest_from_three"),
    )


_GRAM_COUNTS = f"""t AS (SELECT doc_id, {q.tokens('text')} AS t FROM documents),
    g AS (SELECT doc_id, unnest(t || {q.word_bigrams('t')}) AS term FROM t),
    counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM g GROUP BY ALL)"""


def gram_counts(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return tf.term_counts(docs, "doc_id", ng.word_ngrams("text", 1, 2))


@query(
    "top_vocabulary",
    "V4",
    f"""WITH {_GRAM_COUNTS} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS total FROM counts GROUP BY term
        HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000""",
)
def top_vocabulary(spark, d):
    return tf.vocabulary(gram_counts(spark, d), max_features=5000, min_df=2)


@query(
    "sublinear_counts",
    "V5",
    f"""WITH {_GRAM_COUNTS} SELECT doc_id, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS n_grams,
        round(sum(1 + ln(tf)), 4) AS damped FROM counts GROUP BY doc_id""",
)
def sublinear_counts(spark, d):
    counts = gram_counts(spark, d)
    return counts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("tf").alias("n_grams"),
        F.round(F.sum(tf.tf_weight(F.col("tf"), sublinear=True)), 4).alias("damped"),
    )


_UNIGRAMS = f"""g AS (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents),
    counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM g GROUP BY ALL),
    idf AS (SELECT term, count(*)::BIGINT AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY term)"""


def unigram_counts(spark, d):
    return tf.term_counts(documents(spark, d, "doc_id", "text"), "doc_id", ng.word_tokens("text"))


def unigram_idf(spark, d):
    return tf.with_idf(tf.vocabulary(unigram_counts(spark, d)), tf.row_total(table(spark, d, "documents", "doc_id")))


@query("smoothed_idf", "V6", f"WITH {_UNIGRAMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def smoothed_idf(spark, d):
    return unigram_idf(spark, d).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "unit_weights",
    "V7",
    f"""WITH {_UNIGRAMS}, w AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idf USING (term)),
        u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
        SELECT doc_id, term, round(w, 6) AS weight FROM u""",
)
def unit_weights(spark, d):
    # counts and vocabulary are written once; otherwise every join by term reads the texts again
    counts = written(unigram_counts(spark, d))
    known = written(tf.with_idf(tf.vocabulary(counts), tf.row_total(table(spark, d, "documents", "doc_id"))))
    weights = tf.tfidf(counts, "doc_id", known)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "cased_and_masked_tokens",
    "V8",
    rf"""SELECT doc_id, len(list_distinct(a))::INTEGER AS n_cased, len(list_distinct(b))::INTEGER AS n_masked FROM (
        SELECT doc_id, regexp_extract_all(text, '{q.WORD}{{2,}}') AS a,
        regexp_extract_all(regexp_replace(lower(text), '\p{{Nd}}', '0', 'g'), '{q.WORD}{{2,}}') AS b FROM documents)""",
)
def cased_and_masked_tokens(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return docs.select(
        "doc_id",
        F.size(F.array_distinct(ng.word_tokens("text", lowercase=False))).alias("n_cased"),
        F.size(F.array_distinct(ng.word_tokens(tx.mask_digits("text"), lowercase=False))).alias("n_masked"),
    )


_BOTH = f"""rows_t AS (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents),
    refs_t AS (SELECT item_id, unnest({q.tokens('text')}) AS term FROM benchmark),
    rc AS (SELECT doc_id, term, count(*) AS tf FROM rows_t GROUP BY ALL),
    bc AS (SELECT item_id, term, count(*) AS tf FROM refs_t GROUP BY ALL),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf
          FROM (SELECT term FROM rc UNION ALL SELECT term FROM bc) GROUP BY term),
    rw AS (SELECT doc_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS w FROM rc JOIN v USING (term)),
    bw AS (SELECT item_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS w FROM bc JOIN v USING (term)),
    sims AS (SELECT doc_id, item_id, sum(rw.w * bw.w) AS cosine FROM rw JOIN bw USING (term) GROUP BY ALL)"""


def copies_of_benchmark(spark, d, threshold, fit_on_rows=True):
    docs = documents(spark, d, "doc_id", "text")
    items = table(spark, d, "benchmark", "item_id", "text")
    toks = ng.word_tokens("text")
    return tf.near_copies(docs, items, "doc_id", "item_id", toks, toks, threshold, fit_on_rows)


@query(
    "cosine_pairs",
    "V10",
    f"WITH {_BOTH} SELECT doc_id, item_id, round(cosine, 6) AS cosine FROM sims WHERE cosine >= 0.3",
)
def cosine_pairs(spark, d):
    return copies_of_benchmark(spark, d, 0.3).withColumn("cosine", F.round("cosine", 6))


@query(
    "decontaminate",
    "J5",
    f"WITH {_BOTH} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sims WHERE cosine >= 0.5)",
)
def decontaminate(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    return tf.decontaminate(docs, copies_of_benchmark(spark, d, 0.5), "doc_id")


@query(
    "copies_of_reference",
    "J6",
    f"""WITH rows_t AS (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents),
    refs_t AS (SELECT item_id, unnest({q.tokens('text')}) AS term FROM benchmark),
    rc AS (SELECT doc_id, term, count(*) AS tf FROM rows_t GROUP BY ALL),
    bc AS (SELECT item_id, term, count(*) AS tf FROM refs_t GROUP BY ALL),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM bc GROUP BY term),
    rw AS (SELECT doc_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS w FROM rc JOIN v USING (term)),
    bw AS (SELECT item_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS w FROM bc JOIN v USING (term)),
    sims AS (SELECT doc_id, item_id, sum(rw.w * bw.w) AS cosine FROM rw JOIN bw USING (term) GROUP BY ALL)
    SELECT doc_id, round(max(cosine), 6) AS cosine FROM sims WHERE cosine >= 0.8 GROUP BY doc_id""",
)
def copies_of_reference(spark, d):
    pairs = copies_of_benchmark(spark, d, 0.8, fit_on_rows=False)
    return pairs.groupBy("doc_id").agg(F.round(F.max("cosine"), 6).alias("cosine"))


@query(
    "drop_near_copies",
    "J7",
    f"""WITH RECURSIVE {_UNIGRAMS},
    w AS (SELECT doc_id, source, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS w
          FROM counts JOIN idf USING (term) JOIN documents USING (doc_id)),
    near AS (SELECT a.doc_id AS doc_id, list(b.doc_id) AS before FROM
             (SELECT a.doc_id, b.doc_id AS other FROM w a JOIN w b ON a.source = b.source AND a.term = b.term AND b.doc_id > a.doc_id
              GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8) p
             JOIN documents a ON a.doc_id = p.doc_id JOIN documents b ON b.doc_id = p.other GROUP BY a.doc_id),
    ranked AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id DESC) AS rn,
               coalesce(n.before, []) AS before FROM documents d LEFT JOIN near n USING (doc_id)),
    walk AS (SELECT source, 1::BIGINT AS rn, [doc_id] AS kept FROM ranked WHERE rn = 1
             UNION ALL SELECT k.source, k.rn + 1, CASE WHEN list_has_any(r.before, k.kept) THEN k.kept ELSE list_append(k.kept, r.doc_id) END
             FROM walk k JOIN ranked r ON r.source = k.source AND r.rn = k.rn + 1)
    SELECT source, unnest(arg_max(kept, rn)) AS doc_id FROM walk GROUP BY source""",
)
def drop_near_copies(spark, d):
    docs = documents(spark, d)
    kept = neardup.drop_near_copies(
        docs, "doc_id", "source", -F.col("doc_id"), ng.word_tokens("text"), unigram_idf(spark, d)
    )
    return docs.select("doc_id", "source").join(kept, "doc_id", "left_semi")


#: Kept items of the limited class per feed; the feeds of these tables are short.
FEED_LIMIT = 10


@query(
    "second_test",
    "J7 J6 F2 F4 F6 F8 J3 L1",
    f"""WITH RECURSIVE {q.LABELS}, link AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link FROM pages),
    items AS (SELECT d.doc_id, d.source, l.label, d.text, e.ts, k.link FROM documents d JOIN labels_t l USING (doc_id) JOIN events e ON e.event_id = d.doc_id
              LEFT JOIN link k ON k.page_id = d.doc_id),
    recent AS (SELECT * FROM items WHERE ts >= CASE WHEN label = 'fake' THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END
               AND (link IS NULL OR link NOT IN (SELECT k.link FROM link k WHERE k.page_id NOT IN (SELECT doc_id FROM labels)))),
    listed AS (SELECT *, {q.word_count('text')} < CASE WHEN label = 'fake' THEN 20 ELSE 30 END AS short FROM recent
               WHERE link IS NULL OR doc_id IN (SELECT min(doc_id) FROM recent GROUP BY link)),
    refs_t AS (SELECT item_id, unnest({q.tokens('text')}) AS term FROM benchmark),
    bc AS (SELECT item_id, term, count(*) AS tf FROM refs_t GROUP BY ALL),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM bc GROUP BY term),
    bw AS (SELECT item_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS w FROM bc JOIN v USING (term)),
    it AS (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM listed WHERE NOT short),
    ic AS (SELECT doc_id, term, count(*) AS tf FROM it GROUP BY ALL),
    w AS (SELECT doc_id, source, label, ts, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id)) AS w
          FROM ic JOIN v USING (term) JOIN listed USING (doc_id)),
    known AS (SELECT DISTINCT doc_id FROM (SELECT w.doc_id, bw.item_id FROM w JOIN bw USING (term) GROUP BY ALL HAVING sum(w.w * bw.w) >= 0.8)),
    pairs AS (SELECT a.doc_id, b.doc_id AS other FROM w a JOIN w b ON a.source = b.source AND a.label = b.label AND a.term = b.term
              AND (b.ts > a.ts OR (b.ts = a.ts AND b.doc_id < a.doc_id)) GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8),
    near AS (SELECT doc_id, list(other) AS before FROM pairs GROUP BY doc_id),
    ranked AS (SELECT l.doc_id, l.source, l.label, l.short, l.doc_id IN (SELECT doc_id FROM known) AS known, coalesce(n.before, []) AS before,
               row_number() OVER (PARTITION BY l.source, l.label ORDER BY l.ts DESC, l.doc_id) AS rn FROM listed l LEFT JOIN near n USING (doc_id)),
    walk AS (SELECT source, label, 0::BIGINT AS rn, []::BIGINT[] AS kept, 0::BIGINT AS doc_id, NULL::VARCHAR AS reason FROM (SELECT DISTINCT source, label FROM ranked)
             UNION ALL SELECT k.source, k.label, r.rn, CASE WHEN r.short OR list_has_any(r.before, k.kept) OR r.known THEN k.kept ELSE list_append(k.kept, r.doc_id) END,
                r.doc_id, CASE WHEN r.short THEN 'abaixo do mínimo de palavras'
                    WHEN list_has_any(r.before, k.kept) THEN 'quase idêntico a outro item do teste 2 (texto-modelo/repetido)'
                    WHEN r.known THEN 'quase idêntico a texto do corpus ou do teste 1' END
             FROM walk k JOIN ranked r ON r.source = k.source AND r.label = k.label AND r.rn = k.rn + 1
             WHERE k.label = 'fake' OR len(k.kept) < {FEED_LIMIT})
    SELECT doc_id, source, label, reason FROM walk WHERE rn > 0""",
)
def second_test(spark, d):
    links = table(spark, d, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("link"))
    items = labelled(spark, d).join(published(spark, d), "doc_id").join(links.withColumnRenamed("page_id", "doc_id"), "doc_id", "left")
    used = links.join(labels(spark, d).select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")
    references = table(spark, d, "benchmark", "item_id", "text")
    return collect_second_test(items, used, references, "doc_id", "item_id", CUTOFFS, FEED_LIMIT)


@query(
    "term_coefficients",
    "J10",
    f"""WITH {LOG_ODDS_SQL}, cnt AS (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM cnt GROUP BY ALL)
        SELECT doc_id, round(sum(tf * coef), 4) AS score, count(*)::BIGINT AS n_known FROM tf JOIN coefs USING (term) GROUP BY doc_id""",
)
def term_coefficients(spark, d):
    counts = unigram_counts(spark, d)
    coefs = log_odds(spark, d).withColumn("df", F.abs("coef"))
    met = tf.join_by_term(counts, coefs)
    return met.groupBy("doc_id").agg(
        F.round(F.sum(F.col("tf") * F.col("coef")), 4).alias("score"), F.count(F.lit(1)).alias("n_known")
    )


@query(
    "standardized_lengths",
    "V11 V14",
    """WITH n AS (SELECT doc_id, ln(1 + length(text)) AS x FROM documents)
       SELECT doc_id, round((x - (SELECT avg(x) FROM n)) / (SELECT stddev_pop(x) FROM n), 6) AS log_chars FROM n""",
)
def standardized_lengths(spark, d):
    sized = documents(spark, d, "doc_id", "text").select("doc_id", tx.log_chars("text").alias("log_chars"))
    return sc.standardize(sized, ["log_chars"]).withColumn("log_chars", F.round("log_chars", 6))
