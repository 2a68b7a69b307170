"""SentencePiece codec and token counts."""

import random

import numpy as np
import pytest
import sentencepiece
from fixtures import LONG
from pyspark.sql import functions as F

from textsieve.llm import sentencepiece_codec as sp
from textsieve.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def tool():
    return sp.Codec(sp.model_path())


def texts():
    rng = random.Random(7)
    letters = "ab \n▁é日本🙂\x00thhe.,  er in_{(\\"
    return ["", " ", "  hello  world", "\n\nx", "ﬁ", "a\xa0b", LONG[:5000]] + ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(1500)]


def test_ids_equal_the_library(tool, library):
    for text in texts():
        assert tool.encode(text).tolist() == library.encode(text), text


def test_one_long_unbroken_text(tool, library):
    rng = random.Random(3)
    text = "".join(rng.choice("thereinonanmenté") for _ in range(30_000))
    assert tool.encode(text).tolist() == library.encode(text)


def test_stream_holds_a_bounded_window(library):
    encoder = sp.StreamingEncoder(sp.Vocabulary(sp.model_path()))
    rng = random.Random(5)
    out, most, whole = [], 0, ""
    for _ in range(300):
        part = "".join(rng.choice("thereinonanm") for _ in range(17))
        whole += part
        out += encoder.feed(part)
        most = max(most, len(encoder._text))
    out += encoder.finish()
    assert "".join(out) == whole and most < 400
    assert out == encoder.whole(whole)


def test_round_trip(tool):
    for text in texts():
        if "▁" not in text:
            assert tool.decode(tool.encode(text)) == text


def test_a_small_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(sp, "REMEMBERED_CUTS", 3)
    monkeypatch.setattr(sp, "REMEMBERED_PAIRS", 5)
    tool = sp.Codec(sp.model_path())
    for text in texts()[:150]:
        assert tool.encode(text).tolist() == library.encode(text)


def test_encode_and_decode_tables(spark, odd, empty, library):
    coded = sp.encode(odd, keep=("doc_id", "row"))
    rows = {(r["doc_id"], r["row"]): r for r in coded.collect()}
    assert coded.count() == odd.count()
    assert rows[(2, None)]["ids"] is None and rows[(2, None)]["n_ids"] == 0 and rows[(2, None)]["round_trip"] is None
    assert rows[(3, 3)]["ids"] == [] and rows[(3, 3)]["round_trip"]
    assert rows[(7, 7)]["ids"] == library.encode(LONG) and rows[(7, 7)]["round_trip"]
    assert rows[(9, 9)]["round_trip"] is False  # the space mark itself
    back = {r["row"]: r["text"] for r in sp.decode(coded, into="text").collect()}
    assert back[None] is None and back[7] == LONG and back[3] == ""
    assert sp.encode(empty).count() == 0


def spread(lengths, starts, ends, rule):
    """Brute force: one token at a time."""
    counts, outside, crossing, at = [0] * len(starts), 0, 0, 0
    for n in lengths:
        a, b = at, at + n
        at = b
        part = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
        touched = [i for i, x in enumerate(part) if x > 0]
        if not touched:
            outside += 1
            continue
        crossing += part[touched[0]] < n
        if rule == "majority":
            counts[max(touched, key=lambda i: (part[i], -i))] += 1
        else:
            counts[touched[0] if rule == "start" else touched[-1]] += 1
    return counts, outside, crossing


@pytest.mark.parametrize("rule", tc.RULES)
def test_attribution_against_brute_force(rule):
    rng = np.random.default_rng(2)
    for _ in range(300):
        lengths = rng.integers(1, 7, rng.integers(0, 30))
        cuts = np.sort(rng.integers(0, lengths.sum() + 1, 2 * rng.integers(0, 6)))
        starts, ends = cuts[::2], cuts[1::2]
        counts, outside, crossing = tc.attribute(lengths, starts, ends, rule)
        assert (counts.tolist(), outside, crossing) == spread(lengths.tolist(), starts.tolist(), ends.tolist(), rule)


def test_counts_of_lines_add_up(odd, empty):
    tool, _ = tc.encoding(tc.ranks_path())
    rows = {r["row"]: r for r in tc.count_tokens(odd, keep=("row",)).collect()}
    for r in odd.collect():
        got = rows[r["row"]]
        assert got["n_tokens"] == len(tool.encode_ordinary(r["text"] or ""))
        if r["text"] is not None:
            assert sum(got["section_tokens"]) + got["outside_tokens"] == got["n_tokens"]
            assert len(got["section_tokens"]) == r["text"].count("\n") + 1
    assert rows[None]["section_tokens"] is None
    assert tc.count_tokens(empty).count() == 0


def test_given_sections_and_rules(spark):
    df = spark.createDataFrame([(1, "éé hello world", [(0, 4), (4, 99), (3, 2), (None, 1)]), (2, "x", None)], "doc_id long, text string, s array<struct<start:int,end:int>>")
    for rule in tc.RULES:
        first, second = tc.count_tokens(df, F.col("s"), rule=rule).orderBy("doc_id").collect()
        assert sum(first["section_tokens"]) + first["outside_tokens"] == first["n_tokens"] and len(first["section_tokens"]) == 4
        assert second["section_tokens"] is None and second["outside_tokens"] == second["n_tokens"]
    with pytest.raises(ValueError):
        tc.count_tokens(df, F.col("s"), rule="all")
