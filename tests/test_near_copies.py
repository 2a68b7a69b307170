"""Cosine joins on two indexes, greedy removal on the graph, and the second-test plan, against plain loops."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import cosine, make_texts, vectors

from textsieve.functions import fixed_values as fx
from textsieve.functions.ngrams import word_tokens
from textsieve.operators import neardup
from textsieve.operators import tfidf as tf
from textsieve.plans import second_test as st
from textsieve.plans.catalog import all_queries


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def fitted(df):
    return tf.with_idf(tf.vocabulary(tf.term_counts(df, "id", word_tokens("text"))), tf.row_total(df))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_near_copies_whatever_the_blocks(spark, block):
    texts = make_texts(60, 5)
    refs = {100 + i: texts[i] for i in range(0, 12)}
    vec = vectors(refs)
    rows = vectors(texts, refs)
    want = {(i, j) for i in texts for j in refs if cosine(rows[i], vec[j]) >= 0.6}
    a, b = frame(spark, texts), frame(spark, refs).withColumnRenamed("id", "ref")
    toks = word_tokens("text")
    got = tf.near_copies(a, b, "id", "ref", toks, toks, 0.6, fit_on_rows=False, block=block)
    assert {(r.id, r.ref) for r in got.collect()} == want


def test_candidates_are_of_the_order_of_the_hits(spark):
    """Of all pairs of documents and benchmark items, only those near the threshold get full vectors."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("ref"), "text")
    counts = tf.term_counts(items, "ref", word_tokens("text"))
    terms = tf.with_idf(tf.vocabulary(counts), tf.row_total(items))
    own = tf.tfidf(tf.term_counts(docs, "id", word_tokens("text")), "id", terms)
    candidates = tf.candidate_pairs(own, tf.tfidf(counts, "ref", terms), "id", "ref", 0.8).count()
    hits = all_queries()["copies_of_reference"].run(spark, folder).count()
    assert hits <= candidates <= 8 * hits + 200


@pytest.mark.parametrize("block", [2, 512])
def test_rounds_do_not_follow_the_size_of_a_bucket(spark, monkeypatch, block):
    """One text in many near copies, and many texts that share a rare word only: few rounds for both."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(40)]
    texts = {}
    for i in range(120):
        words = list(base)
        words[rng.randrange(40)] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(120, 240):
        texts[i] = " ".join(["shared", *(f"y{rng.randrange(400)}" for _ in range(12))])
    df = frame(spark, texts).withColumn("g", F.lit(None).cast("string"))
    rounds = []
    real = neardup.cut_lineage
    monkeypatch.setattr(neardup, "cut_lineage", lambda d, *a: rounds.append(d.columns) or real(d, *a))
    got = {r.id for r in neardup.drop_near_copies(df, "id", "g", F.col("id"), word_tokens("text"), fitted(df), 0.8, block).collect()}
    vec, kept = vectors(texts), []
    for i in sorted(texts):
        if all(cosine(vec[i], vec[j]) < 0.8 for j in kept):
            kept.append(i)
    assert got == set(kept)
    assert sum(c == ["id", "_other"] for c in rounds) <= 6


def test_left_out_equals_the_greedy_reading(spark):
    rng = random.Random(2)
    edges = {(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(500)) if a < b} | {(i, i + 1) for i in range(300, 312)}
    kept, gone = set(), set()
    for i in range(320):
        (gone if any((j, i) in edges for j in kept) else kept).add(i)
    got = neardup.left_out(spark.createDataFrame(sorted(edges), "id long, _other long"), "id")
    assert sorted(r.id for r in got.collect()) == sorted(gone)
    assert neardup.left_out(spark.createDataFrame([], "id long, _other long"), "id").count() == 0


def plain_second_test(items, used, refs, cutoffs, limit):
    known_links, seen, fresh = {u for u in used if u}, {}, []
    for item in sorted(items):
        i, source, label, link, ts, text = item
        if ts is None or label not in cutoffs or ts < cutoffs[label] or link in known_links or (link and link in seen):
            continue
        if link:
            seen[link] = i
        fresh.append(item)
    ref_vec = vectors(refs)
    vec = vectors({i[0]: i[5] or "" for i in items}, refs)
    out, kept = [], defaultdict(list)
    for i, source, label, link, ts, text in sorted(fresh, key=lambda r: (-r[4].timestamp(), r[0])):
        mine = kept[source, label]
        if label == "true" and len(mine) >= limit:
            continue
        if len((text or "").split()) < (20 if label == "fake" else 30):
            reason = fx.REASON_SHORT
        elif any(cosine(vec[i], vec[j]) >= 0.8 for j in mine):
            reason = fx.REASON_REPEATED
        elif any(cosine(vec[i], r) >= 0.8 for r in ref_vec.values()):
            reason = fx.REASON_KNOWN
        else:
            reason = None
            mine.append(i)
        out.append((i, source, label, reason))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_second_test_equals_a_plain_reading(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]

    def fresh_text():
        return [rng.choice(vocabulary) for _ in range(rng.choice((10, 25, 40, 40, 60)))]

    def varied(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    pool = [fresh_text() for _ in range(12)]
    refs = {k: " ".join(varied(pool[k % 6], 2)) for k in range(18)} | {20 + k: " ".join(vocabulary[k * 10 : k * 10 + 10]) for k in range(8)}
    start = datetime.datetime(2024, 1, 1)
    items = []
    for i in range(220):
        text = " ".join(varied(rng.choice(pool), rng.choice((0, 0, 1, 3, 6)))) if rng.random() < 0.8 else " ".join(fresh_text())
        link = rng.choice((None, f"l{rng.randrange(60)}", f"only{i}", f"only{i}"))
        ts = rng.choice((None, *[start + datetime.timedelta(days=rng.randrange(12))] * 8))
        items.append((i, rng.choice(("a", "b", None)), rng.choice(("true", "true", "fake", None)), link, ts, rng.choice((text,) * 15 + (None, "unknown words only " * 12))))
    used = ["l1", "l2", None]
    cutoffs = {"fake": "2024-01-02 00:00:00", "true": "2024-01-04 00:00:00"}
    df = spark.createDataFrame(items, "id long, source string, label string, link string, ts timestamp, text string")
    links = spark.createDataFrame([(u,) for u in used], "link string")
    references = spark.createDataFrame(list(refs.items()), "ref long, text string")
    got = st.second_test(df, links, references, "id", "ref", cutoffs, limit=4)
    want = plain_second_test(items, used, refs, {k: datetime.datetime.fromisoformat(v) for k, v in cutoffs.items()}, 4)
    assert sorted(((r["id"], r["source"], r["label"], r["reason"]) for r in got.collect()), key=repr) == want
    assert min(Counter(r[3] for r in want)[x] for x in (None, fx.REASON_SHORT, fx.REASON_REPEATED, fx.REASON_KNOWN)) >= 2
    empty = st.second_test(df.limit(0), links, references, "id", "ref", cutoffs)
    assert empty.count() == 0


def test_cosine_joins_leave_no_table_behind(spark):
    """Counts, vectors and indexes are freed; texts are read once, and what is left does not grow with the rows."""
    import os

    from textsieve.session import shared_dir

    left = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("written-")}
    before, toks = left(), word_tokens("text")
    texts = make_texts(40, 5)
    df = frame(spark, texts).withColumn("g", F.lit("a"))
    refs = frame(spark, {100 + i: texts[i] for i in range(5)}).withColumnRenamed("id", "ref")
    pairs = tf.near_copies(df, refs, "id", "ref", toks, toks, 0.6)
    assert left() == before and pairs.count() >= 5
    neardup.drop_near_copies(df, "id", "g", F.col("id"), toks, fitted(df)).count()
    assert left() == before


def test_vectors_carry_their_bounds(spark):
    texts = make_texts(30, 5)
    df = frame(spark, texts)
    own = tf.tfidf(tf.term_counts(df, "id", word_tokens("text")), "id", fitted(df))
    carried = tf.leading_bounds(own, "id", 0.6)
    key = lambda rows: sorted((r.id, r.term, r.weight, r.after, r.rest) for r in rows)
    assert carried.count() == own.count()
    assert key(tf.leading_index(carried, "id", 0.6).collect()) == key(tf.leading_index(own, "id", 0.6).collect())
