"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import groups as gr
from ...sources.tables import documents, labelled, labels, table
from . import sql_parts as q
from .registry import query
from .text_queries import _KINDS, quoted_documents


@query(
    "label_counts",
    "A1",
    """SELECT d.source, l.quality::INTEGER AS quality, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id)
       GROUP BY ALL""",
)
def label_counts(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    rows = docs.join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    "describe_by_label",
    "A2",
    f"""WITH {q.CORPUS}, n AS (SELECT label, length(text) AS n FROM corpus)
        SELECT label, count(n)::BIGINT AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
        min(n)::BIGINT AS low, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.5)::DOUBLE AS median,
        quantile_cont(n, 0.75)::DOUBLE AS q3, max(n)::BIGINT AS high FROM n GROUP BY label""",
)
def describe_by_label(spark, d):
    sized = labelled(spark, d).select("label", F.length("text").cast("long").alias("n"))
    quartiles = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    wide = sized.groupBy("label").agg(
        F.count("n").alias("n_rows"),
        F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.stddev_samp("n"), 6).alias("std"),
        F.min("n").alias("low"),
        quartiles.alias("q"),
        F.max("n").alias("high"),
    )
    return wide.select(
        "label", F.col("n_rows").alias("n"), "mean", "std", "low",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high",
    )


@query(
    "quantiles_by_label",
    "A3",
    f"""WITH {q.CORPUS}, n AS (SELECT label, {q.word_count('text')} AS n FROM corpus)
        SELECT label, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.25)::DOUBLE AS p25,
        quantile_cont(n, 0.75)::DOUBLE AS p75 FROM n GROUP BY label""",
)
def quantiles_by_label(spark, d):
    sized = labelled(spark, d).select("label", tx.word_count("text").alias("n"))
    wide = sized.groupBy("label").agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q"))
    return wide.select(
        "label", F.col("q")[0].alias("median"), F.col("q")[1].alias("p25"), F.col("q")[2].alias("p75")
    )


@query(
    "marker_rate_by_label",
    "A4",
    f"""WITH {q.CORPUS} SELECT label, round(avg(CASE WHEN regexp_matches(lower(text), '(^|{q.NON_WORD})(the|les)({q.NON_WORD}|$)')
        THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM corpus GROUP BY label""",
)
def marker_rate_by_label(spark, d):
    flag = tx.mentions("text", "the|les").cast("double")
    return labelled(spark, d).groupBy("label").agg(F.round(F.avg(flag) * 100, 6).alias("pct"))


@query(
    "language_crosstab",
    "A5",
    f"""WITH {q.LABELS} SELECT d.source, count(*) FILTER (d.lang = 'de')::BIGINT AS de, count(*) FILTER (d.lang = 'en')::BIGINT AS en,
        count(*) FILTER (d.lang = 'es')::BIGINT AS es, count(*) FILTER (d.lang = 'fr')::BIGINT AS fr
        FROM documents d JOIN labels_t l USING (doc_id) GROUP BY d.source""",
)
def language_crosstab(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source", "lang").join(labels(spark, d), "doc_id")
    table_ = rows.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)))
    return table_.fillna(0)


@query(
    "distinct_per_group",
    "A6",
    f"""WITH {q.CORPUS} SELECT label, count(DISTINCT source)::BIGINT AS n_sources,
        count(DISTINCT length(text))::BIGINT AS n_lengths FROM corpus GROUP BY label""",
)
def distinct_per_group(spark, d):
    return labelled(spark, d).groupBy("label").agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct(F.length("text")).alias("n_lengths")
    )


@query(
    "periods_by_source",
    "A7",
    f"""WITH {q.LABELS} SELECT CASE WHEN l.doc_id IS NULL THEN 'rest' ELSE 'labelled' END AS split, coalesce(l.label, 'none') AS label,
        d.source, count(*)::BIGINT AS n, strftime(min(e.ts), '%Y-%m-%d') AS first_day, strftime(max(e.ts), '%Y-%m-%d') AS last_day,
        count(*) FILTER (length(d.text) > 1000)::BIGINT AS n_long
        FROM documents d LEFT JOIN labels_t l USING (doc_id) LEFT JOIN events e ON e.event_id = d.doc_id GROUP BY ALL""",
)
def periods_by_source(spark, d):
    from ...sources.tables import published

    rows = documents(spark, d).join(labels(spark, d), "doc_id", "left").join(published(spark, d), "doc_id", "left")
    split = F.when(F.col("label").isNull(), "rest").otherwise("labelled")
    return rows.groupBy(split.alias("split"), F.coalesce("label", F.lit("none")).alias("label"), "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
        F.count_if(F.length("text") > 1000).alias("n_long"),
    )


@query(
    "complete_pairs",
    "A8",
    """WITH g AS (SELECT conv_id, list_sort(list(role)) = ['assistant', 'user'] AS complete FROM conversations GROUP BY conv_id)
       SELECT conv_id, complete FROM g""",
)
def complete_pairs(spark, d):
    rows = table(spark, d, "conversations", "conv_id", "role")
    return gr.complete_pairs(rows, "conv_id", "role", ("assistant", "user"))


@query(
    "mean_and_max_by_setting",
    "A9",
    """SELECT o_orderpriority AS setting, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS best FROM orders GROUP BY 1""",
)
def mean_and_max_by_setting(spark, d):
    return table(spark, d, "orders", "o_orderpriority", "o_totalprice").groupBy(
        F.col("o_orderpriority").alias("setting")
    ).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("best"))


@query(
    "fold_mean_and_spread",
    "A10",
    f"""WITH {q.CORPUS}, f AS (SELECT source, avg(CASE WHEN label = 'true' THEN 1.0 ELSE 0.0 END) * 100 AS acc FROM corpus GROUP BY source)
        SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS spread FROM f""",
)
def fold_mean_and_spread(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source").join(labels(spark, d), "doc_id")
    per_fold = rows.groupBy("source").agg((F.avg((F.col("label") == "true").cast("double")) * 100).alias("acc"))
    return per_fold.agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_pop("acc"), 6).alias("spread"))


@query(
    "votes_per_text",
    "A13",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS s FROM embeddings)
       SELECT vec_id, count(*) FILTER (s >= 0)::BIGINT AS votes_true, count(*) FILTER (s < 0)::BIGINT AS votes_fake
       FROM v GROUP BY vec_id""",
)
def votes_per_text(spark, d):
    votes = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.explode("embedding").alias("s"))
    vote = tx.score_to_label(F.col("s").cast("double"))
    return votes.groupBy("vec_id").agg(
        F.count_if(vote == "true").alias("votes_true"), F.count_if(vote == "fake").alias("votes_fake")
    )


@query(
    "source_map_per_row",
    "A14 S11",
    f"""WITH {q.LABELS}, w AS (SELECT d.source, avg(CASE WHEN l.label = 'fake' THEN length(d.text) END) AS fake,
            avg(CASE WHEN l.label = 'true' THEN length(d.text) END) AS "true",
            avg(CASE WHEN l.label IS NULL THEN length(d.text) END) AS unlabelled
        FROM documents d LEFT JOIN labels_t l USING (doc_id) GROUP BY d.source)
        SELECT source, k AS name, round(v, 6) AS value FROM (
            SELECT source, 'fake' AS k, fake AS v FROM w UNION ALL SELECT source, 'true', "true" FROM w
            UNION ALL SELECT source, 'unlabelled', unlabelled FROM w) WHERE v IS NOT NULL""",
)
def source_map_per_row(spark, d):
    from ...operators.results import columns_to_map

    rows = documents(spark, d).join(labels(spark, d), "doc_id", "left")
    named = F.coalesce("label", F.lit("unlabelled"))
    wide = rows.withColumn("kind", named).groupBy("source").pivot("kind", ["fake", "true", "unlabelled"])
    means = wide.agg(F.avg(F.length("text")))
    mapped = means.select("source", columns_to_map(["fake", "true", "unlabelled"]).alias("m"))
    return mapped.select("source", F.explode("m").alias("name", "value")).withColumn("value", F.round("value", 6))


@query(
    "balance_weights",
    "A16",
    f"""WITH {q.LABELS}, n AS (SELECT label, count(*) AS n FROM labels_t GROUP BY label)
        SELECT label, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)::DOUBLE, 6) AS weight FROM n""",
)
def balance_weights(spark, d):
    from ...operators.scaling import class_weights

    return class_weights(labels(spark, d), "label").withColumn("weight", F.round("weight", 6))


@query(
    "kind_rates_by_band",
    "E11 A4",
    f"""WITH {_KINDS}, n AS (SELECT kind, t, len({q.words('t')}[1:50]) AS n FROM kinds)
        SELECT kind, CASE WHEN n BETWEEN 1 AND 19 THEN '<20' WHEN n BETWEEN 20 AND 29 THEN '20-29'
            WHEN n BETWEEN 30 AND 49 THEN '30-49' WHEN n = 50 THEN '50' END AS band,
            count(*)::BIGINT AS n, round(avg(CASE WHEN ln(1 + length(t)) < 7 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_fake
        FROM n GROUP BY ALL""",
)
def kind_rates_by_band(spark, d):
    rows = quoted_documents(spark, d)
    band = tx.length_band(tx.word_count(tx.first_words("t", 50)))
    guess = tx.score_to_label(tx.log_chars("t") - 7)
    return rows.groupBy("kind", band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((guess == "fake").cast("double")) * 100, 6).alias("pct_fake")
    )
