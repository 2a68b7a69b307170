"""Cleaning, typing and measuring text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import dates, text as tx
from ...functions import fixed_values as fx
from ...functions.ngrams import char_ngrams
from ...sources.tables import documents, labelled, table
from . import sql_parts as q
from .registry import query


@query(
    "normalize_label",
    "P1",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'fake' END AS label FROM labels""",
)
def normalize_label(spark, d):
    raw = F.when(F.col("quality") == 1, " TRUE ").otherwise("False\t")
    return table(spark, d, "labels", "doc_id", "quality").select("doc_id", tx.normalize_label(raw).alias("label"))


@query(
    "clean_text",
    "P2",
    f"""SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest
        FROM (SELECT doc_id, {q.clean("'  ' || chr(65279) || text")} AS t FROM documents)""",
)
def clean_text(spark, d):
    marked = F.concat(F.lit("  \ufeff"), "text")
    docs = documents(spark, d, "doc_id", "text").select("doc_id", tx.clean_text(marked).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("rename_column", "P3", "SELECT conv_id AS pair_id, turn, role AS label FROM conversations")
def rename_column(spark, d):
    turns = table(spark, d, "conversations", "conv_id", "turn", "role")
    return turns.withColumnsRenamed({"conv_id": "pair_id", "role": "label"})


@query(
    "code_to_label",
    "P4",
    """SELECT doc_id, CASE toxic WHEN 1 THEN 'fake' WHEN 0 THEN 'true' END AS label FROM labels""",
)
def code_to_label(spark, d):
    return table(spark, d, "labels", "doc_id", "toxic").select("doc_id", tx.code_to_label("toxic").alias("label"))


@query(
    "first_fifty_words",
    "P5",
    f"SELECT doc_id, {q.first_words('text', 50)} AS short_text FROM documents",
)
def first_fifty_words(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.first_words("text", 50).alias("short_text"))


@query("excerpt_sixty_words", "P6", f"SELECT doc_id, {q.first_words('text', 60)} AS excerpt FROM documents")
def excerpt_sixty_words(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.excerpt("text").alias("excerpt"))


@query("word_count", "P7", f"SELECT doc_id, {q.word_count('text')} AS n_words FROM documents")
def word_count(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.word_count("text").cast("long").alias("n_words"))


@query(
    "char_count",
    "P8",
    """SELECT doc_id, length(text)::BIGINT AS n_chars, round(ln(1 + length(text)), 6) AS log_chars
       FROM documents""",
)
def char_count(spark, d):
    return documents(spark, d, "doc_id", "text").select(
        "doc_id",
        tx.char_count("text").cast("long").alias("n_chars"),
        F.round(tx.log_chars("text"), 6).alias("log_chars"),
    )


_ESCAPED = r"replace(replace(text, chr(10), '\n'), ', ', '\t')"


@query(
    "repair_escapes",
    "P9",
    rf"""WITH e AS (SELECT doc_id, {_ESCAPED} AS raw FROM documents),
    f AS (SELECT doc_id, raw, {q.strip(r"regexp_replace(regexp_replace(regexp_replace(raw, '\\r\\n|\\n|\\r', chr(10), 'g'), '\\t', ' ', 'g'), '[ \t]+', ' ', 'g')")} AS fixed FROM e)
    SELECT doc_id, regexp_matches(raw, '\\[nt]') AS has_escape,
           len(regexp_extract_all(raw, '\\[nt]'))::BIGINT AS n_escapes, md5(fixed) AS digest FROM f""",
)
def repair_escapes(spark, d):
    raw = F.replace(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit(", "), F.lit("\\t"))
    docs = documents(spark, d, "doc_id", "text").select("doc_id", raw.alias("raw"))
    return docs.select(
        "doc_id",
        F.col("raw").rlike(r"\\[nt]").alias("has_escape"),
        tx.escape_count("raw").cast("long").alias("n_escapes"),
        F.md5(tx.repair_escapes("raw")).alias("digest"),
    )


@query(
    "drop_title",
    "P10",
    f"""WITH s AS (SELECT doc_id, text, {q.strip("regexp_extract(" + q.strip("text") + ", '^[^" + chr(92) + "n]*" + chr(92) + "n((?s:.*))$', 1)")} AS by_line,
           {q.drop_first_sentence('text')} AS by_sentence FROM documents)
    SELECT doc_id, md5(CASE WHEN by_line <> '' THEN by_line ELSE text END) AS without_line,
           md5(by_sentence) AS without_sentence FROM s""",
)
def drop_title(spark, d):
    return documents(spark, d, "doc_id", "text").select(
        "doc_id",
        F.md5(tx.drop_first_line("text")).alias("without_line"),
        F.md5(tx.drop_first_sentence("text")).alias("without_sentence"),
    )


@query(
    "title_words_by_label",
    "P11",
    f"""WITH {q.CORPUS}, t AS (SELECT label, {q.word_count('text')} - {q.word_count(q.drop_first_sentence('text'))} AS n FROM corpus)
    SELECT label, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_with_title,
           round(avg(n), 6) AS mean_title_words FROM t GROUP BY label""",
)
def title_words_by_label(spark, d):
    sized = labelled(spark, d).select("label", tx.title_word_count("text").alias("n"))
    return sized.groupBy("label").agg(
        F.round(F.avg((F.col("n") > 0).cast("double")) * 100, 6).alias("pct_with_title"),
        F.round(F.avg("n"), 6).alias("mean_title_words"),
    )


_DOMAIN = r"nullif(lower(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1)), '')"


@query("url_domain", "P12", f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", tx.domain("url").alias("domain"))


PAGE_OUTLETS = ["m.th", "example.com", "example.net", "th"]


@query(
    "url_outlet",
    "P13",
    f"""SELECT page_id, CASE WHEN contains(dom, 'm.th') THEN 'm' WHEN contains(dom, 'example.com') THEN 'example'
        WHEN contains(dom, 'example.net') THEN 'example' WHEN contains(dom, 'th') THEN 'th' ELSE 'other' END AS outlet
        FROM (SELECT page_id, coalesce({_DOMAIN}, '') AS dom FROM pages)""",
)
def url_outlet(spark, d):
    return table(spark, d, "pages", "page_id", "url").select(
        "page_id", tx.outlet(tx.domain("url"), PAGE_OUTLETS, "other").alias("outlet")
    )


VOCABULARY = r"the|les|erst\w*|ment\w*|und"


@query(
    "mentions_vocabulary",
    "P14",
    f"""SELECT doc_id,
        regexp_matches(lower(text), '(^|{q.NON_WORD})(the|les|erst{q.WORD}*|ment{q.WORD}*|und)({q.NON_WORD}|$)') AS has_word,
        regexp_matches(text, '(^|{q.NON_WORD})(The|Les|Und)({q.NON_WORD}|$)') AS has_cased_word
        FROM documents""",
)
def mentions_vocabulary(spark, d):
    return documents(spark, d, "doc_id", "text").select(
        "doc_id",
        tx.mentions("text", VOCABULARY).alias("has_word"),
        tx.mentions("text", "The|Les|Und", fold_case=False).alias("has_cased_word"),
    )


# The first line of every text becomes a quotation, so the rules on quoted leads have input.
_QUOTED = r"""regexp_replace(text, '^([^\n]*)\n', '“\1”' || chr(10))"""
_LEAD = r"""nullif(regexp_extract(t, '^[“"]([^\n]+?)[”"]', 1), '')"""
_KINDS = f"""{q.LABELS},
quoted AS (SELECT d.doc_id, l.label, {_QUOTED} AS t FROM documents d LEFT JOIN labels_t l USING (doc_id)),
leads AS (SELECT doc_id, label, t, {_LEAD} AS quote,
    regexp_matches(lower(t), '(^|{q.NON_WORD})(the|les|erst{q.WORD}*|ment{q.WORD}*|und)({q.NON_WORD}|$)') AS marked FROM quoted),
kinds AS (SELECT *, CASE WHEN label = 'true' THEN 'true_resumida'
    WHEN {q.word_count('quote')} >= 20 THEN 'fake_boato_citado'
    WHEN marked THEN 'fake_texto_checagem' ELSE 'fake_outros' END AS kind FROM leads)"""


def quoted_documents(spark, d):
    from ...sources.tables import labels

    t = F.regexp_replace("text", r"^([^\n]*)\n", "“$1”\n")
    docs = documents(spark, d, "doc_id", "text").select("doc_id", t.alias("t"))
    rows = docs.join(labels(spark, d), "doc_id", "left")
    leads = rows.select(
        "doc_id", "label", "t", tx.quoted_lead("t").alias("quote"), tx.mentions("t", VOCABULARY).alias("marked")
    )
    return leads.withColumn("kind", tx.text_kind("label", "quote", "marked"))


@query("quoted_lead", "P15", f"WITH {_KINDS} SELECT doc_id, quote FROM kinds")
def quoted_lead(spark, d):
    return quoted_documents(spark, d).select("doc_id", "quote")


@query("text_kind", "P16", f"WITH {_KINDS} SELECT doc_id, kind FROM kinds")
def text_kind(spark, d):
    return quoted_documents(spark, d).select("doc_id", "kind")


@query(
    "base_text",
    "P17",
    f"""WITH {_KINDS} SELECT doc_id, kind, md5(CASE WHEN kind = 'fake_boato_citado' THEN quote ELSE t END) AS digest
        FROM kinds""",
)
def base_text(spark, d):
    rows = quoted_documents(spark, d)
    return rows.select("doc_id", "kind", F.md5(tx.base_text("kind", "quote", "t")).alias("digest"))


@query(
    "publication_year",
    "P18",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderstatus = 'F' THEN year(o_orderdate)::INTEGER
        WHEN o_orderpriority < '3' AND year(o_orderdate) >= 2000 THEN year(o_orderdate)::INTEGER END AS year FROM orders""",
)
def publication_year(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    stated = F.when(
        F.col("o_orderstatus").isin("O", "F"), F.concat(F.lit("em "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    ).otherwise("99/99/2020")
    url = F.when(F.col("o_orderpriority") < "3", F.concat(F.lit("http://a/"), F.year("o_orderdate"), F.lit("/b")))
    return orders.select("o_orderkey", dates.publication_year(stated, url).alias("year"))


OPENINGS = r"the|les|erst\w*|e\w*|der"


@query(
    "description_opening",
    "P19",
    f"""SELECT doc_id, regexp_matches(lower({q.strip('text')}), '^(the|les|erst{q.WORD}*|e{q.WORD}*|der)({q.NON_WORD}|$)') AS described
        FROM documents""",
)
def description_opening(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.opens_with("text", OPENINGS).alias("described"))


@query(
    "length_band",
    "P20",
    f"""WITH n AS (SELECT doc_id, len({q.words('text')}[1:50]) AS n FROM documents)
    SELECT doc_id, CASE WHEN n BETWEEN 1 AND 19 THEN '<20' WHEN n BETWEEN 20 AND 29 THEN '20-29'
        WHEN n BETWEEN 30 AND 49 THEN '30-49' WHEN n = 50 THEN '50' END AS band FROM n""",
)
def length_band(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    sized = docs.select("doc_id", tx.word_count(tx.first_words("text", 50)).alias("n"))
    return sized.select("doc_id", tx.length_band("n").alias("band"))


@query(
    "proportional_features",
    "P21",
    rf"""WITH c AS (SELECT doc_id, length(text) AS n_characters, {q.word_count('text')} AS n_words,
        len(regexp_extract_all(text, '\p{{Lu}}{q.WORD}*')) AS n_upper, len(regexp_extract_all(text, '[,;:]')) AS n_pauses
        FROM documents), b AS (SELECT *, CASE WHEN n_words = 0 THEN 1 ELSE n_words END AS base FROM c)
    SELECT doc_id, round(n_upper / base * 100, 6) AS pct_upper, round(n_pauses / base * 100, 6) AS pct_pauses,
        round(n_characters / base, 6) AS characters_per_word FROM b""",
)
def proportional_features(spark, d):
    counts = documents(spark, d, "doc_id", "text").select(
        "doc_id",
        F.length("text").alias("n_characters"),
        tx.word_count("text").alias("n_words"),
        F.regexp_count("text", F.lit(rf"\p{{Lu}}{tx.WORD_CHAR}*")).alias("n_upper"),
        F.regexp_count("text", F.lit("[,;:]")).alias("n_pauses"),
    )
    return counts.select(
        "doc_id",
        F.round(tx.per_hundred("n_upper", "n_words"), 6).alias("pct_upper"),
        F.round(tx.per_hundred("n_pauses", "n_words"), 6).alias("pct_pauses"),
        F.round(tx.per_hundred("n_characters", "n_words") / 100, 6).alias("characters_per_word"),
    )


@query(
    "fill_missing_number",
    "P22",
    """SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS n_links FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def fill_missing_number(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    sparse = docs.join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return sparse.withColumnRenamed("quality", "n_links").fillna({"n_links": 0})


@query(
    "parse_mixed_dates",
    "P23",
    """SELECT event_id, CASE event_type WHEN 'click' THEN epoch(date_trunc('second', ts))::BIGINT + 10800
        WHEN 'view' THEN epoch(date_trunc('day', ts))::BIGINT
        WHEN 'purchase' THEN epoch(date_trunc('second', ts))::BIGINT
        WHEN 'error' THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS epoch_seconds FROM events""",
)
def parse_mixed_dates(spark, d):
    events = table(spark, d, "events", "event_id", "event_type", "ts")
    feed = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    written = (
        F.when(F.col("event_type") == "click", F.concat(feed, F.lit(" -0300")))
        .when(F.col("event_type") == "view", F.date_format("ts", "dd/MM/yyyy"))
        .when(F.col("event_type") == "purchase", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(F.col("event_type") == "error", "sem data")
        .otherwise(F.concat(feed, F.lit(" +0000")))
    )
    return events.select("event_id", F.unix_timestamp(dates.parse_mixed(written)).alias("epoch_seconds"))


@query(
    "mask_digits",
    "P24",
    r"""SELECT doc_id, md5(regexp_replace(lower(text || ' ' || n_chars), '\p{Nd}', '0', 'g')) AS digest FROM documents""",
)
def mask_digits(spark, d):
    docs = documents(spark, d, "doc_id", "text", "n_chars")
    return docs.select("doc_id", F.md5(tx.mask_digits(F.concat_ws(" ", "text", "n_chars"))).alias("digest"))


@query(
    "score_to_label",
    "P25",
    "SELECT vec_id, CASE WHEN embedding[1]::DOUBLE >= 0 THEN 'true' ELSE 'fake' END AS predicted FROM embeddings",
)
def score_to_label(spark, d):
    vecs = table(spark, d, "embeddings", "vec_id", "embedding")
    return vecs.select("vec_id", tx.score_to_label(F.get("embedding", F.lit(0)).cast("double")).alias("predicted"))


@query(
    "certainty_band",
    "P26",
    f"""SELECT doc_id, CASE WHEN abs(s) < 0.2 THEN 'doubt' WHEN abs(s) < 0.6 THEN 'moderate' ELSE 'high' END AS certainty,
        n < 20 AS short_input
        FROM (SELECT doc_id, ln(1 + length(text)) - 7 AS s, {q.word_count('text')} AS n FROM documents)""",
)
def certainty_band(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return docs.select(
        "doc_id",
        tx.certainty_band(tx.log_chars("text") - 7).alias("certainty"),
        tx.short_input(tx.word_count("text")).alias("short_input"),
    )


@query(
    "split_model_name",
    "P27",
    """SELECT o_orderkey, o_orderpriority AS model, 'sem ' || o_orderstatus AS scenario FROM orders""",
)
def split_model_name(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    name = F.concat("o_orderpriority", F.lit(" | sem "), "o_orderstatus", F.lit(" no treino"))
    named = orders.select("o_orderkey", tx.split_name(name, drop=" no treino").alias("n"))
    return named.select("o_orderkey", "n.model", "n.scenario")


@query(
    "readable_grams",
    "P28",
    rf"""WITH g AS (SELECT unnest({q.char_grams("lower(text)", 3, 5)}) AS g FROM conversations)
    SELECT regexp_replace(replace(g, ' ', '·'), '[\p{{C}}\p{{Z}}]', '?', 'g') AS gram, count(*)::BIGINT AS n FROM g
    WHERE len(regexp_extract_all(g, '\p{{L}}')) >= 4 GROUP BY 1""",
)
def readable_grams(spark, d):
    grams = table(spark, d, "conversations", "text").select(F.explode(char_ngrams("text", 3, 5)).alias("g"))
    totals = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(tx.letter_count("g") >= 4)
    return totals.groupBy(tx.readable_gram("g").alias("gram")).agg(F.sum("n").alias("n"))


@query("preview_text", "P29", "SELECT doc_id, substring(text, 1, 300) AS preview FROM documents")
def preview_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.preview("text").alias("preview"))


@query(
    "mean_text_lengths",
    "P30",
    """SELECT 'text' AS "column", round(avg(length(text)), 6) AS mean_chars FROM documents
       UNION ALL SELECT 'lang', round(avg(length(lang)), 6) FROM documents
       UNION ALL SELECT 'source', round(avg(length(source)), 6) FROM documents""",
)
def mean_text_lengths(spark, d):
    rows = tx.mean_text_lengths(table(spark, d, "documents"))
    return rows.select("column", F.round("mean_chars", 6).alias("mean_chars"))


@query("drop_leak_columns", "P31", "SELECT doc_id, n_chars FROM documents")
def drop_leak_columns(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars")
    safe = tx.drop_leaks(docs.withColumnsRenamed({"source": "author", "lang": "category"}))
    tx.assert_no_leaks(safe.columns)
    return safe
