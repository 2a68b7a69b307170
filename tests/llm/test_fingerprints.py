"""Merkle fingerprints: exact edited texts, equality by root, likeness and places of edits against plain counts."""

import hashlib
import random
from collections import Counter

import pytest
from fixtures import sentence

from textsieve.llm import merkle_fingerprints as mf


def text_of(rng, words, lines=9):
    out = []
    for k, w in enumerate(sentence(rng, words)):
        out.append(w + rng.choice((" ", " ", " ", "\n", "\n\n", "  ") if k % lines == 0 else " "))
    return "".join(out)


def pieces_of(text):
    data, out, at = text.encode(), [], 0
    for end in mf.cuts(data)[0].tolist() if data else ():
        out.append(data[at:end])
        at = end
    assert b"".join(out) == data
    return out


ODD = ["", "a", "a b", "\n", "\n\n", "x\n\ny", " lead", "trail ", "é", "日本語" * 400, "x" * 5000, "🙂\n" * 50, "a\r\n\r\nb", "\x00 \x00"]


def test_pieces_cover_the_text_and_do_not_cut_characters():
    rng = random.Random(1)
    for text in [*ODD, *(text_of(rng, n) for n in (5, 50, 2000))]:
        for p in pieces_of(text):
            p.decode()
    assert 3 < len(text_of(rng, 3000).split()) / len(pieces_of(text_of(rng, 3000))) < 8


def test_equal_texts_and_only_those_have_equal_roots():
    rng = random.Random(2)
    texts = [*ODD, *(text_of(rng, n) for n in (1, 2, 3, 30, 30, 300)), "a b\n", "a\nb", "a  b"]
    marks = [mf.fingerprint(t) for t in texts]
    assert len({m[:22] for m in marks}) == len(set(texts))
    assert [mf.fingerprint(t) for t in texts] == marks and mf.fingerprint(None) == mf.fingerprint("")


def test_likeness_and_differences_equal_plain_counts():
    """Descending the trees finds the same pieces in common as comparing all pieces, when no piece repeats."""
    rng = random.Random(3)
    for _ in range(60):
        one = text_of(rng, rng.choice((10, 100, 1000)))
        words = one.split(" ")
        for _ in range(rng.choice((1, 2, 10))):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        two = rng.choice((" ".join(words), one[: len(one) // 2] + text_of(rng, 50), text_of(rng, 40)))
        a, b = Counter(pieces_of(one)), Counter(pieces_of(two))
        x, y = mf.fingerprint(one), mf.fingerprint(two)
        if max(a.values()) == max(b.values()) == 1:
            assert mf.likeness(x, y) == pytest.approx(1.0 if one == two else 2 * (a & b).total() / (a.total() + b.total()))
            assert mf.likeness(x, y) == mf.likeness(y, x)
            assert len(mf.differences(x, y)) == (a - b).total()
    assert mf.likeness(mf.fingerprint(""), mf.fingerprint("a")) == 0 and mf.likeness(mf.fingerprint(""), mf.fingerprint(None)) == 1


def test_an_edit_is_located_in_its_branch():
    rng = random.Random(4)
    lines = [" ".join(sentence(rng, 12)) for _ in range(60)]
    old = "\n".join(lines)
    changed = list(lines)
    changed[40] = changed[40].replace(changed[40].split()[5], "edited")
    places = mf.differences(mf.fingerprint(old), mf.fingerprint("\n".join(changed)))
    upto, at = 0, None
    for s, (_, paragraphs) in enumerate(mf.tree(mf.fingerprint(old))):
        if upto <= 40 < upto + len(paragraphs):
            at = (s, 40 - upto)
        upto += len(paragraphs)
    assert upto == 60 and places and {p[:2] for p in places} == {at}


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        marks = [mf.fingerprint(x) for x in (t, new, nxt)]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), *marks[:2], mf.likeness(*marks[:2]), mf.likeness(marks[0], marks[2])))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_query_equals_brute_force(spark, parts):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + 3 * i, text_of(rng, rng.choice((3, 40, 400)))) for i in range(60)] + [(50, None), (None, "without an id"), (None, "without an id"), (0, ""), (0, "")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(mf.against_next(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert got(mf.against_next(one)) == brute([(1, "abc def")])


def test_half_kept_texts_are_nearer_than_the_next(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, 200)) for i in range(100)]
    found = mf.against_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0.3 < r["near_edited"] < 0.7 and r["near_next"] < 0.1 for r in found)


def test_odd_rows(spark, odd, empty):
    found = mf.against_next(odd).collect()
    assert sorted(repr((r["doc_id"], r["n_chars"])) for r in found) == sorted(repr((r["doc_id"], len(r["text"] or ""))) for r in odd.collect())
    assert mf.against_next(empty).count() == 0
    clash = odd.withColumnRenamed("score", "Fingerprint")
    marked = mf.fingerprints(clash)
    assert marked.columns[-1] == "fingerprint" and marked.count() == odd.count()
