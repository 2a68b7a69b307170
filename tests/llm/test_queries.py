"""Registered queries: SQL parity where there is SQL, whole tables for all, the pipeline stage by stage."""

import types

import compare
import pytest

import __spark_entry__
import corpus_pipeline
from textsieve.llm import jaccard_join, quality_model, sentencepiece_codec, spaced_seeds
from textsieve.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    item = types.SimpleNamespace(run=QUERIES[name], sql=SQL[name])
    assert compare.compare(spark, compare.duck(SF), item, SF) is None


@pytest.mark.parametrize(("name", "table", "key"), [("op1_jaccard_join", "documents", "doc_id"), ("op2_surrogates", "documents", "doc_id"), ("op3_html_layout", "pages", "page_id"), ("op7_sentencepiece", "documents", "doc_id"), ("op10_token_counts", "documents", "doc_id")])
def test_one_row_for_every_row(spark, name, table, key):
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in QUERIES[name](spark, SF).select(key).collect()) == want


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        ids = [r["doc_id"] for r in after]
        if name == "quality_classifier":
            scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()}
            want = [r["doc_id"] for r in before if scores[r["doc_id"]] >= 0.7]
        elif name == "jaccard_join":
            want = [r["id"] for r in jaccard_join.classes(docs, 5, 80).collect() if r["id"] == r["component_id"]]
        elif name == "decontamination":
            leaked = {r["key"] for r in spaced_seeds.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            want = [r["doc_id"] for r in before if r["doc_id"] not in leaked]
        else:
            want = [r["doc_id"] for r in before]
        assert sorted(ids) == sorted(want) and ids, name
        if name == "sentencepiece":
            tool = sentencepiece_codec.codec(sentencepiece_codec.model_path())
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(tool.decode(r["ids"]) == texts[r["doc_id"]] and r["round_trip"] for r in after)
        else:
            assert out.columns == columns
            if name != "surrogates":
                assert set(map(tuple, after)) <= set(map(tuple, before))
            docs = out


def test_pipeline_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)


def test_pipeline_odd_and_empty_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name == "jaccard_join":
            assert len(rows) == odd.count() - 1  # the repeated row stays once
        elif name != "quality_classifier":
            assert len(rows) == odd.count()
        if name == "sentencepiece":
            assert {"row", "score", "ids"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
        else:
            assert out.columns == odd.columns and {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}


def test_pipeline_keeps_one_row_of_each_group_whatever_the_ids(spark):
    """Near and exact copies with null ids, with and without an id in the group; one id with two texts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(100)) for x in "abcd")
    rows = [(3, a, 1), (5, a + " more", 2), (5, b, 3), (None, a + " less", 4), (None, c, 5), (None, c, 6), (None, c + " more", 7), (7, d, 8), (7, d + " more", 9), (8, "", 10), (8, "", 11), (9, "", 12), (None, None, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted(r["row"] for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect())
    c_rows, d_rows, e_rows = ({5, 6, 7}, {8, 9}, {10, 11})
    assert {1, 3, 12, 13} <= set(got) and len(got) == 7
    assert all(len(set(got) & x) == 1 for x in (c_rows, d_rows, e_rows))
