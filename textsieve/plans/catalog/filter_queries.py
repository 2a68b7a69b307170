"""Filters, duplicates, rejection reasons and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as fx
from ...functions import text as tx
from ...operators import groups as gr
from ...operators.ranking import keep_first
from ...sources.tables import documents, labelled, labels, published, table
from . import sql_parts as q
from .registry import query


@query("drop_known_group", "F1", "SELECT doc_id, source FROM documents WHERE source <> 'src7'")
def drop_known_group(spark, d):
    return table(spark, d, "documents", "doc_id", "source").where(F.col("source") != "src7")


@query(
    "minimum_words_by_class",
    "F2",
    f"""WITH {q.CORPUS} SELECT doc_id, label FROM corpus
        WHERE {q.word_count('text')} >= CASE WHEN label = 'fake' THEN 20 ELSE 30 END""",
)
def minimum_words_by_class(spark, d):
    enough = gr.minimum_words(tx.word_count("text"), F.col("label"), {"fake": 20}, 30)
    return labelled(spark, d).where(enough).select("doc_id", "label")


@query(
    "drop_duplicate_texts",
    "F3",
    "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
)
def drop_duplicate_texts(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    return keep_first(docs, F.col("text"), "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query(
    "drop_duplicate_links",
    "F4",
    """WITH l AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link FROM pages)
       SELECT min(page_id) AS page_id, link FROM l GROUP BY link""",
)
def drop_duplicate_links(spark, d):
    links = table(spark, d, "pages", "page_id", "url").select(
        "page_id", F.regexp_replace("url", "[?#].*$", "").alias("link")
    )
    return links.groupBy("link").agg(F.min("page_id").alias("page_id"))


@query(
    "url_rules_by_source",
    "F5",
    """WITH l AS (SELECT page_id, url, nullif(lower(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS dom FROM pages)
       SELECT page_id, dom FROM l WHERE NOT (contains(dom, 'example.com') AND (NOT contains(url, '/en/') OR contains(url, '?page=')))
          AND NOT (contains(dom, 'example.net') AND (contains(url, '/fr/') OR contains(url, '/de/')))""",
)
def url_rules_by_source(spark, d):
    links = table(spark, d, "pages", "page_id", "url").select("page_id", "url", tx.domain("url").alias("dom"))
    url, dom = F.col("url"), F.col("dom")
    unwanted_com = dom.contains("example.com") & (~url.contains("/en/") | url.contains("?page="))
    translations = dom.contains("example.net") & (url.contains("/fr/") | url.contains("/de/"))
    return links.where(~unwanted_com & ~translations).select("page_id", "dom")


CUTOFFS = {"fake": "2024-01-05 00:00:00", "true": "2024-01-10 00:00:00"}


@query(
    "publication_cutoff_by_class",
    "F6",
    f"""WITH {q.LABELS} SELECT l.doc_id, l.label FROM labels_t l LEFT JOIN events e ON e.event_id = l.doc_id
        WHERE e.ts >= CASE WHEN l.label = 'fake' THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END""",
)
def publication_cutoff_by_class(spark, d):
    from ...functions.dates import on_or_after

    dated = labels(spark, d).join(published(spark, d), "doc_id", "left")
    return dated.where(on_or_after("ts", "label", CUTOFFS)).select("doc_id", "label")


@query(
    "drop_missing_label",
    "F7",
    """SELECT d.doc_id, l.quality, year(e.ts)::INTEGER AS year FROM documents d LEFT JOIN labels l USING (doc_id)
       LEFT JOIN events e ON e.event_id = d.doc_id
       WHERE l.quality IS NOT NULL AND year(e.ts) BETWEEN 2016 AND 2024""",
)
def drop_missing_label(spark, d):
    rows = (
        table(spark, d, "documents", "doc_id")
        .join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
        .join(published(spark, d), "doc_id", "left")
        .select("doc_id", "quality", F.year("ts").alias("year"))
    )
    return rows.dropna(subset=["quality"]).where(F.col("year").between(2016, 2024))


def with_reason(spark, d):
    """Rejection reasons of the labelled corpus, most basic rule first."""
    rows = labelled(spark, d)
    short = ~gr.minimum_words(tx.word_count("text"), F.col("label"), {"fake": 20}, 30)
    reason = gr.first_reason(
        (short, fx.REASON_SHORT),
        (F.col("source").isin("src3", "src4"), "anúncio"),
        (F.col("text").contains("copyright"), "texto-modelo"),
    )
    return rows.select("doc_id", "source", reason.alias("reason"))


_REASONS = f"""{q.CORPUS},
reasons AS (SELECT doc_id, source, CASE
    WHEN {q.word_count('text')} < CASE WHEN label = 'fake' THEN 20 ELSE 30 END THEN 'abaixo do mínimo de palavras'
    WHEN source IN ('src3', 'src4') THEN 'anúncio'
    WHEN contains(text, 'copyright') THEN 'texto-modelo' END AS reason FROM corpus)"""


@query("rejected_with_reason", "F8", f"WITH {_REASONS} SELECT doc_id, source, reason FROM reasons WHERE reason IS NOT NULL")
def rejected_with_reason(spark, d):
    return gr.rejected(with_reason(spark, d))


@query("kept_after_rules", "F8", f"WITH {_REASONS} SELECT doc_id, source FROM reasons WHERE reason IS NULL")
def kept_after_rules(spark, d):
    return gr.kept(with_reason(spark, d))


BLOCKS = [("src2", "nota oficial"), ("src11", "tradução"), ("src_unknown", "chave ausente")]
_BLOCKS = "blocks(source, reason) AS (VALUES ('src2', 'nota oficial'), ('src11', 'tradução'), ('src_unknown', 'chave ausente'))"


def block_list(spark):
    return spark.createDataFrame(BLOCKS, "source string, reason string")


@query(
    "block_list",
    "F9",
    f"""WITH {_BLOCKS} SELECT d.doc_id, d.source, b.reason, b.reason IS NULL AS stays FROM documents d
        LEFT JOIN blocks b USING (source)""",
)
def block_list_query(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    marked = gr.apply_block_list(docs, block_list(spark), "source")
    return marked.select("doc_id", "source", "reason", F.col("reason").isNull().alias("stays"))


@query(
    "unknown_block_keys",
    "F9 U5",
    f"WITH {_BLOCKS} SELECT source, reason FROM blocks WHERE source NOT IN (SELECT source FROM documents)",
)
def unknown_block_keys(spark, d):
    docs = table(spark, d, "documents", "source")
    return gr.unknown_blocks(docs, block_list(spark), "source").select("source", "reason")


@query(
    "extraction_rejects",
    "F10",
    """WITH p AS (SELECT page_id, url, CASE WHEN NOT contains(url, '/en/') THEN 'não é /noticia/'
            WHEN NOT regexp_matches(html, '<article>') THEN 'sem trecho extraído' END AS reason FROM pages)
       SELECT page_id, url, reason FROM p WHERE reason IS NOT NULL""",
)
def extraction_rejects(spark, d):
    pages = table(spark, d, "pages", "page_id", "url", "html")
    reason = gr.first_reason(
        (~F.col("url").contains("/en/"), fx.REASON_NOT_ARTICLE),
        (~F.col("html").contains("<article>"), fx.REASON_NO_EXCERPT),
    )
    return gr.rejected(pages.select("page_id", "url", reason.alias("reason")))


@query(
    "repeated_links",
    "F11",
    """SELECT url, count(*)::BIGINT AS n FROM pages GROUP BY url HAVING count(*) > 1""",
)
def repeated_links(spark, d):
    return gr.repeated_keys(table(spark, d, "pages", "url"), "url")


@query(
    "corpus_audit",
    "F12",
    f"""WITH {q.CORPUS},
    g AS (SELECT source, count(*) FILTER (label = 'fake') > 0 AND count(*) FILTER (label = 'true') > 0 AS has_both FROM corpus GROUP BY source),
    y AS (SELECT count(*) FILTER (e.ts IS NULL) AS missing FROM corpus c LEFT JOIN events e ON e.event_id = c.doc_id),
    u AS (SELECT count(DISTINCT text) AS n FROM corpus)
    SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (label = 'fake')::BIGINT AS n_fake,
        count(*) FILTER (label = 'true')::BIGINT AS n_true, count(*) FILTER (contains(text, chr(65279)))::BIGINT AS n_bom,
        count(*) FILTER (text IS NULL)::BIGINT AS n_null, (count(*) - (SELECT n FROM u))::BIGINT AS n_repeated,
        (SELECT count(*) FILTER (has_both) FROM g)::BIGINT AS complete_groups, (SELECT count(*) FROM g)::BIGINT AS n_groups,
        (SELECT missing FROM y)::BIGINT AS n_undated FROM corpus""",
)
def corpus_audit(spark, d):
    rows = labelled(spark, d)
    per_group = rows.groupBy("source").agg(F.count_distinct("label").alias("n_labels")).agg(
        F.count_if(F.col("n_labels") == 2).alias("complete"), F.count(F.lit(1)).alias("n")
    )
    distinct = rows.select(F.sha2("text", 256).alias("p")).distinct().agg(F.count(F.lit(1)).alias("n"))
    undated = labels(spark, d).join(published(spark, d), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    one = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == "fake").alias("n_fake"),
        F.count_if(F.col("label") == "true").alias("n_true"),
        F.count_if(F.col("text").contains("\ufeff")).alias("n_bom"),
        F.count_if(F.col("text").isNull()).alias("n_null"),
    )
    return one.select(
        "*",
        (F.col("n_rows") - distinct.scalar()).alias("n_repeated"),
        per_group.select("complete").scalar().alias("complete_groups"),
        per_group.select("n").scalar().alias("n_groups"),
        undated.scalar().alias("n_undated"),
    )
