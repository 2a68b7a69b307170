"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from textsieve.llm import spelling_variants as sv


def lowered(run):
    return re.sub("[A-Z]", lambda m: m[0].lower(), run)


def counted(rows, least=2):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    out, form = [], {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
        out.append((w, n, len(others)))

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, k, words.get(form[w])) for w, n, k in out)


def corpus(seed):
    rng = random.Random(seed)
    parts = ["an", "the", "ré", "çon", "tion", "Er", "ing", "ü", "aa", "st"]
    stems = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 6))) for _ in range(40)]
    vocabulary = []
    for stem in stems:
        vocabulary += [stem] * rng.choice((1, 3, 40, 400))
        for _ in range(rng.randrange(25)):
            at, letter = rng.randrange(len(stem)), rng.choice("abcdeéü")
            made = rng.choice((stem[:at] + stem[at + 1 :], stem[:at] + letter + stem[at:], stem[:at] + letter + stem[at + 1 :]))
            vocabulary += [made] * rng.choice((1, 2, 3, 30))
    vocabulary += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab"] * 3 + ["abcdefg" + c for c in "abcdefghijklmnopqrstuvwxyz"] * 2
    rng.shuffle(vocabulary)
    return [(i, " ".join(vocabulary[i * 40 : i * 40 + 40]) + rng.choice((".", "-1", "_x"))) for i in range(len(vocabulary) // 40 + 1)]


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "group"), [(1, 24), (2, 1), (3, 3)])
def test_equal_to_all_pairs(spark, seed, group):
    rows = [*corpus(seed), (None, "withoutid withoutid Zeitung"), (4, None), (5, ""), (6, "Zeitung ×÷×÷×÷× ×÷×÷×÷×")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(sv.variants(df, group=group)) == want
    assert sum(x[1] is not None for x in want) > 10 and any(x[1] != x[2] for x in want if x[1])


def test_each_pair_once(spark):
    words = {w: 1 for w in counted(corpus(4), 1)}
    pairs = sv.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group=2).collect()
    seen = [tuple(sorted((r["a"], r["b"]))) for r in pairs]
    assert sorted(seen) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_long_texts_are_cut_between_runs():
    text = "word " * 50 + "x" * 300 + " end-of é" * 20
    for size in (1, 7, 64, 10_000):
        assert "".join(sv.slices(text, size)) == text
        assert [r for s in sv.slices(text, size) for r in sv._RUN.findall(s)] == sv._RUN.findall(text)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(sv.variants(odd)) == brute(rows)
    assert sv.variants(empty).count() == 0


def test_pairs_met_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(5)
    words = {"shared" + "".join(rng.choice("abcdefghij") for _ in range(8)): 1 for _ in range(1500)}
    sizes = []
    real = sv.verified

    def counting(rows):
        sizes.append(rows.where(~rows.gram).groupBy("key").count().selectExpr("sum(count * count)").first()[0] or 0)
        return real(rows)

    monkeypatch.setattr(sv, "verified", counting)
    sv.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).count()
    assert sum(sizes) < 100 * len(words)
