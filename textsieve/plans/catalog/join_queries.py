"""Equi joins, semi and anti joins, lookups and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import groups as gr
from ...sources.tables import documents, labels, table
from . import sql_parts as q
from .registry import query

_PAIRS = f"""turns AS (SELECT conv_id AS pair_id, role AS label, turn, text, {q.word_count('text')} AS n FROM conversations)"""


def turns(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "role", "turn", "text")
    return rows.withColumnsRenamed({"conv_id": "pair_id", "role": "label"})


@query(
    "join_on_pair_and_label",
    "J1",
    f"""WITH {_PAIRS}, a AS (SELECT pair_id, label, min(turn) AS first_turn FROM turns GROUP BY ALL),
        b AS (SELECT pair_id, label, sum(n)::BIGINT AS n_words FROM turns GROUP BY ALL)
        SELECT pair_id, label, first_turn, n_words FROM a JOIN b USING (pair_id, label)""",
)
def join_on_pair_and_label(spark, d):
    rows = turns(spark, d)
    keys = ["pair_id", "label"]
    first = rows.groupBy(*keys).agg(F.min("turn").alias("first_turn"))
    size = rows.groupBy(*keys).agg(F.sum(tx.word_count("text").cast("long")).alias("n_words"))
    return first.join(size, keys)


@query(
    "pairs_all_long",
    "J2",
    f"""WITH {_PAIRS}, ok AS (SELECT pair_id FROM turns GROUP BY pair_id HAVING min(n) >= 15)
        SELECT pair_id, turn, {q.first_words('text', 15)} AS text FROM turns WHERE pair_id IN (SELECT pair_id FROM ok)""",
)
def pairs_all_long(spark, d):
    return gr.groups_all_long(turns(spark, d), "pair_id", "text", 15).select("pair_id", "turn", "text")


@query(
    "pairs_both_labels_long",
    "J2",
    f"""WITH {_PAIRS}, ok AS (SELECT pair_id FROM turns WHERE n >= 30 AND label <> 'system' GROUP BY pair_id
            HAVING count(DISTINCT label) = 2)
        SELECT pair_id, turn, {q.first_words('text', 30)} AS text FROM turns
        WHERE label <> 'system' AND pair_id IN (SELECT pair_id FROM ok)""",
)
def pairs_both_labels_long(spark, d):
    rows = turns(spark, d).where(F.col("label") != "system")
    return gr.groups_both_labels(rows, "pair_id", "label", "text", 30).select("pair_id", "turn", "text")


@query(
    "unused_documents",
    "J3",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unused_documents(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    return docs.join(table(spark, d, "labels", "doc_id"), "doc_id", "left_anti")


HELD = ["src1", "src5"]


@query(
    "hold_out_sources",
    "J4 M13",
    f"""WITH {q.CORPUS} SELECT doc_id, label, CASE WHEN source IN ('src1', 'src5') THEN 'held' ELSE 'train' END AS corpus
        FROM corpus""",
)
def hold_out_sources(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source").join(labels(spark, d), "doc_id")
    train, held = gr.hold_out(rows, "source", HELD)
    return gr.union_named(train=train, held=held).select("doc_id", "label", "corpus")


@query(
    "reason_lookup",
    "J8",
    """WITH reasons(event_type, reason) AS (VALUES ('error', 'falha'), ('click', 'interação'))
       SELECT event_id, reason FROM events LEFT JOIN reasons USING (event_type)""",
)
def reason_lookup(spark, d):
    reasons = spark.createDataFrame([("error", "falha"), ("click", "interação")], "event_type string, reason string")
    events = table(spark, d, "events", "event_id", "event_type")
    return gr.apply_block_list(events, reasons, "event_type").select("event_id", "reason")


@query(
    "methods_by_tests",
    "J9",
    f"""WITH {q.CORPUS}, m(method, cut) AS (VALUES ('short', 4.0), ('medium', 7.0), ('long', 9.0)),
        s AS (SELECT source, label, method, CASE WHEN ln(1 + length(text)) >= cut THEN 'true' ELSE 'fake' END AS p
              FROM corpus CROSS JOIN m)
        SELECT method, source AS test, count(*)::BIGINT AS n, count(*) FILTER (label = p)::BIGINT AS hits
        FROM s GROUP BY ALL""",
)
def methods_by_tests(spark, d):
    rows = documents(spark, d).join(labels(spark, d), "doc_id")
    cuts = {"short": 4.0, "medium": 7.0, "long": 9.0}
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("cut")) for m, c in cuts.items()])
    sized = rows.select("source", "label", tx.log_chars("text").alias("s"), F.explode(methods).alias("m"))
    hit = tx.score_to_label(F.col("s") - F.col("m.cut")) == F.col("label")
    return sized.groupBy(F.col("m.method").alias("method"), F.col("source").alias("test")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")
    )
