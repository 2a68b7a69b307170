"""Unions, repetition, length augmentation and set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...operators import groups as gr
from ...sources.tables import documents, labelled, table
from . import sql_parts as q
from .registry import query

_PARTS = f"""{q.CORPUS}, parts AS (
    SELECT 'docs' AS corpus, text, label FROM corpus
    UNION ALL SELECT 'talk', text, CASE WHEN role = 'user' THEN 'fake' ELSE 'true' END FROM conversations
    UNION ALL SELECT 'bench', text, 'true' FROM benchmark)"""


def parts(spark, d):
    """Named training corpora in one frame."""
    talk = table(spark, d, "conversations", "text", "role").select(
        "text", F.when(F.col("role") == "user", "fake").otherwise("true").alias("label")
    )
    bench = table(spark, d, "benchmark", "text").withColumn("label", F.lit("true"))
    return gr.union_named(docs=labelled(spark, d).select("text", "label"), talk=talk, bench=bench)


@query(
    "union_of_corpora",
    "U1 M25",
    f"WITH {_PARTS} SELECT corpus, label, md5(text) AS digest FROM parts",
)
def union_of_corpora(spark, d):
    return parts(spark, d).select("corpus", "label", F.md5("text").alias("digest"))


@query(
    "combination_sizes",
    "M12 U2",
    f"""WITH {_PARTS}, c(combo, corpus, k) AS (VALUES ('docs', 'docs', 1), ('docs+bench', 'docs', 1), ('docs+bench', 'bench', 1),
        ('docs+talk', 'docs', 1), ('docs+talk', 'talk', 1), ('talk+benchx3', 'talk', 1), ('talk+benchx3', 'bench', 3),
        ('docs+talk+benchx5', 'docs', 1), ('docs+talk+benchx5', 'talk', 1), ('docs+talk+benchx5', 'bench', 5))
        SELECT combo, label, sum(k)::BIGINT AS n FROM parts JOIN c USING (corpus) GROUP BY ALL""",
)
def combination_sizes(spark, d):
    combos = ["docs", "docs+bench", "docs+talk", "talk+benchx3", "docs+talk+benchx5"]
    rows, out = parts(spark, d), None
    for combo in combos:
        names, repeats = gr.parse_combo(combo)
        chosen = gr.choose_corpora(rows.drop("text"), names, repeats)
        n = chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(combo).alias("combo"), "label", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "repeat_corpus",
    "U2",
    f"""WITH {_PARTS} SELECT corpus, copy::INTEGER AS copy, md5(text) AS digest
        FROM (SELECT *, unnest(range(1, CASE WHEN corpus = 'bench' THEN 4 ELSE 2 END)) AS copy FROM parts)""",
)
def repeat_corpus(spark, d):
    chosen = gr.choose_corpora(parts(spark, d), ["docs", "talk", "bench"], {"bench": 3})
    return chosen.select("corpus", "copy", F.md5("text").alias("digest"))


@query(
    "length_augmentation",
    "U3",
    f"""WITH {q.CORPUS} SELECT doc_id, label, 30::INTEGER AS cut, {q.first_words('text', 30)} AS text FROM corpus
        UNION ALL SELECT doc_id, label, 50, {q.first_words('text', 50)} FROM corpus
        UNION ALL SELECT doc_id, label, 100, {q.first_words('text', 100)} FROM corpus""",
)
def length_augmentation(spark, d):
    return gr.cut_lengths(labelled(spark, d).select("doc_id", "label", "text"), "text")


@query(
    "distinct_union_of_ids",
    "U4",
    """SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer""",
)
def distinct_union_of_ids(spark, d):
    a = table(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "id")
    b = table(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    return a.union(b).distinct()


@query(
    "ids_not_used",
    "U5",
    """SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders""",
)
def ids_not_used(spark, d):
    a = table(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    b = table(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "id").distinct()
    return a.join(b, "id", "left_anti")
