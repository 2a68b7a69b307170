"""Group facts on rows, splits, neighbours, ranks, limits and seeded picks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ...functions import text as tx
from ...functions.ngrams import word_tokens
from ...operators import groups as gr
from ...operators import splits
from ...operators.ranking import carry_forward, hash_key, sequential_id, take_seeded
from ...sources.tables import documents, labelled, labels, table
from . import sql_parts as q
from .registry import query


def hash_sql(seed: int, identity: str) -> str:
    return f"('0x' || substring(md5('{seed}:' || {identity}), 1, 12))::BIGINT"


@query(
    "group_all_flag",
    "W1 M14",
    f"""WITH {q.CORPUS}, f AS (SELECT conv_id, turn, role, length(text) >= 100 AS long FROM conversations)
        SELECT conv_id, turn, bool_and(long) OVER (PARTITION BY conv_id) AS all_long FROM f""",
)
def group_all_flag(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "turn", "text")
    flagged = rows.select("conv_id", "turn", (F.length("text") >= 100).alias("long"))
    return gr.with_group_facts(flagged, ["conv_id"], all_long=F.bool_and("long")).drop("long")


@query(
    "group_distinct_count",
    "W2",
    """SELECT c.conv_id, c.turn, g.n_roles FROM conversations c JOIN
       (SELECT conv_id, count(DISTINCT role)::BIGINT AS n_roles FROM conversations GROUP BY conv_id) g USING (conv_id)""",
)
def group_distinct_count(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "turn", "role")
    return gr.with_group_facts(rows, ["conv_id"], n_roles=F.count_distinct("role")).drop("role")


_DATED = f"""{q.CORPUS}, dated AS (SELECT c.doc_id, c.source, c.label, CASE WHEN e.event_type <> 'error' THEN e.ts END AS ts
    FROM corpus c LEFT JOIN events e ON e.event_id = c.doc_id)"""


def dated(spark, d):
    """Corpus keys with a publication time; error events carry none, so nulls are exercised."""
    rows = table(spark, d, "documents", "doc_id", "source").join(labels(spark, d), "doc_id")
    events = table(spark, d, "events", "event_id", "event_type", "ts")
    times = events.where(F.col("event_type") != "error").select(F.col("event_id").alias("doc_id"), "ts")
    return rows.join(times, "doc_id", "left")


@query(
    "recency_split",
    "W3",
    f"""WITH {_DATED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC NULLS LAST, doc_id) AS rn,
        count(*) OVER (PARTITION BY source) AS n FROM dated)
        SELECT doc_id, source, CASE WHEN rn <= round_even(0.3 * n, 0) THEN 'val' ELSE 'treino' END AS split FROM r""",
)
def recency_split(spark, d):
    return splits.recency_split(dated(spark, d), "source", "ts", "doc_id").select("doc_id", "source", "split")


@query(
    "random_split",
    "W4",
    f"""WITH {_DATED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS rn,
        count(*) OVER (PARTITION BY source) AS n FROM dated)
        SELECT doc_id, source, CASE WHEN rn <= round_even(0.3 * n, 0) THEN 'val' ELSE 'treino' END AS split FROM r""",
)
def random_split(spark, d):
    return splits.random_split(dated(spark, d), "source", "doc_id").select("doc_id", "source", "split")


@query(
    "split_by_class_rule",
    "W3 W4",
    f"""WITH {_DATED}, m AS (SELECT source, arg_min(label, doc_id) AS mode FROM dated GROUP BY source),
        r AS (SELECT doc_id, dated.source, mode, row_number() OVER (PARTITION BY dated.source ORDER BY ts DESC NULLS LAST, doc_id) AS newest,
            row_number() OVER (PARTITION BY dated.source ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS shuffled,
            count(*) OVER (PARTITION BY dated.source) AS n FROM dated JOIN m USING (source))
        SELECT doc_id, source, CASE WHEN CASE WHEN mode = 'fake' THEN newest ELSE shuffled END <= round_even(0.3 * n, 0)
            THEN 'val' ELSE 'treino' END AS split FROM r""",
)
def split_by_class_rule(spark, d):
    return splits.split_by_class(dated(spark, d), "source", "label", "ts", "doc_id").select("doc_id", "source", "split")


@query(
    "token_neighbours",
    "W5",
    f"""WITH t AS (SELECT conv_id, turn, {q.words('text')} AS w FROM conversations),
        p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t)
        SELECT conv_id, turn, (i - 1)::INTEGER AS pos, w[i] AS token, CASE WHEN i > 1 THEN w[i - 1] END AS before,
        concat_ws(' ', w[i + 1], w[i + 2]) AS after FROM p""",
)
def token_neighbours(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "turn", "text")
    near = rows.select(
        "conv_id",
        "turn",
        F.posexplode(
            tx.let(
                tx.words("text"),
                lambda w: F.transform(
                    w,
                    lambda t, i: F.struct(
                        t.alias("token"),
                        F.when(i > 0, F.get(w, i - 1)).alias("before"),
                        F.concat_ws(" ", F.get(w, i + 1), F.get(w, i + 2)).alias("after"),
                    ),
                ),
            )
        ).alias("pos", "t"),
    )
    return near.select("conv_id", "turn", "pos", "t.token", "t.before", "t.after")


@query(
    "share_of_class",
    "W6",
    f"""WITH {q.CORPUS}, n AS (SELECT label, source, count(*) AS n FROM corpus GROUP BY ALL)
        SELECT label, source, n::BIGINT AS n, round(100 * n / sum(n) OVER (PARTITION BY label), 6) AS pct FROM n""",
)
def share_of_class(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source").join(labels(spark, d), "doc_id")
    sizes = rows.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))
    shared = gr.with_group_facts(sizes, ["label"], total=F.sum("n"))
    return shared.select("label", "source", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))


@query(
    "first_rows_per_source",
    "W7",
    """SELECT source, doc_id, rn::INTEGER AS rn FROM (SELECT source, doc_id,
       row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 4""",
)
def first_rows_per_source(spark, d):
    # The optimizer limits each group before the shuffle, so a hot source sends four rows per task.
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("doc_id")))
    return table(spark, d, "documents", "source", "doc_id").withColumn("rn", rank).where("rn <= 4")


@query(
    "carry_caption",
    "W8 S4",
    """WITH c AS (SELECT conv_id, turn, text, CASE WHEN role <> 'assistant' THEN text END AS caption, role FROM conversations)
       SELECT conv_id, turn, md5(last_value(caption IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS caption FROM c""",
)
def carry_caption(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    marked = rows.select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("text")).alias("head"))
    filled = carry_forward(marked, ["conv_id"], "turn", "head", "caption", span=4)
    return filled.select("conv_id", "turn", F.md5("caption").alias("caption"))


@query(
    "largest_domains",
    "L1",
    """SELECT nullif(lower(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS domain, count(*)::BIGINT AS n
       FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 10""",
)
def largest_domains(spark, d):
    sizes = table(spark, d, "pages", "url").groupBy(tx.domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "domain").limit(10)


LOG_ODDS_SQL = f"""{q.CORPUS}, tk AS (SELECT DISTINCT doc_id, label, unnest({q.tokens('text')}) AS term FROM corpus),
    coefs AS (SELECT term, ln((count(*) FILTER (label = 'true') + 1.0) / (count(*) FILTER (label = 'fake') + 1.0)) AS coef
              FROM tk GROUP BY term)"""


def log_odds(spark, d):
    """A weight per term from document counts by class; stands in for fitted coefficients."""
    terms = labelled(spark, d).select("label", F.explode(F.array_distinct(word_tokens("text"))).alias("term"))
    n_true = F.count_if(F.col("label") == "true") + 1.0
    n_fake = F.count_if(F.col("label") == "fake") + 1.0
    return terms.groupBy("term").agg(F.log(n_true / n_fake).alias("coef"))


@query(
    "strongest_terms_by_sign",
    "L2 M22",
    f"""WITH {LOG_ODDS_SQL}, s AS (SELECT term, coef, CASE WHEN coef < 0 THEN 'fake' ELSE 'true' END AS side FROM coefs WHERE coef <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round(abs(coef), 9) DESC, term) AS rn FROM s)
        SELECT side, term, round(coef, 6) AS coef, rn::INTEGER AS rn FROM r WHERE rn <= 30""",
)
def strongest_terms_by_sign(spark, d):
    from ...operators.explain import strongest_by_sign

    return strongest_by_sign(log_odds(spark, d), 30).withColumn("coef", F.round("coef", 6))


@query(
    "longest_line",
    "L3",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {q.word_count('line')} DESC, i) AS rn FROM u)
        SELECT doc_id, i::INTEGER AS pos, md5(line) AS digest FROM r WHERE rn = 1""",
)
def longest_line(spark, d):
    from ...functions.pages import longest_by_words

    lines = documents(spark, d, "doc_id", "text").select("doc_id", longest_by_words(F.split("text", "\n")).alias("b"))
    return lines.select("doc_id", F.col("b.pos").alias("pos"), F.md5("b.text").alias("digest"))


@query(
    "balanced_true_sample",
    "L4",
    f"""WITH {q.CORPUS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS rn FROM corpus WHERE label = 'true')
        SELECT doc_id FROM r WHERE rn <= (SELECT count(*) FROM corpus WHERE label = 'fake')""",
)
def balanced_true_sample(spark, d):
    rows = labels(spark, d)
    rows = table(spark, d, "documents", "doc_id").join(rows, "doc_id")
    n_fake = rows.where(F.col("label") == "fake").agg(F.count(F.lit(1))).scalar()
    return take_seeded(rows.where(F.col("label") == "true").select("doc_id"), "doc_id", n_fake)


@query(
    "preview_sample_by_label",
    "L5",
    f"""WITH {q.CORPUS}, r AS (SELECT label, doc_id, substring(text, 1, 300) AS preview,
        row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS rn FROM corpus)
        SELECT label, doc_id, preview FROM r WHERE rn <= 3""",
)
def preview_sample_by_label(spark, d):
    order = W.partitionBy("label").orderBy(hash_key(42, "doc_id"), "doc_id")
    shown = labelled(spark, d).select("label", "doc_id", tx.preview("text").alias("preview"))
    return shown.withColumn("rn", F.row_number().over(order)).where("rn <= 3").drop("rn")


@query(
    "sequential_id",
    "L6",
    f"""WITH {q.CORPUS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM corpus""",
)
def sequential_id_query(spark, d):
    rows = table(spark, d, "documents", "doc_id").join(labels(spark, d), "doc_id").select("doc_id")
    return sequential_id(rows, "doc_id")
