"""Edge rules of the column functions on small hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from textsieve.functions import dates, fixed_values as fx, masking, ngrams, numbers, pages
from textsieve.functions import text as tx


def values(spark, rows, column, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_clean_and_words(spark):
    assert values(spark, ["\ufeffA  b\tc "], tx.clean_text("a")) == ["A b c"]
    rows = ["", "um dois", "  a b  ", None]
    assert values(spark, rows, tx.word_count("a")) == [0, 2, 2, 0]
    assert values(spark, ["um dois\x1ctres quatro", ""], tx.first_words("a", 3)) == ["um dois tres", ""]
    assert values(spark, ["só três palavras"], tx.first_words("a", 50)) == ["só três palavras"]


def test_labels(spark):
    assert values(spark, [" False", "TRUE ", "fake"], tx.normalize_label("a")) == ["fake", "true", "fake"]
    assert values(spark, [1, 0, 7], tx.code_to_label("a"), "a int") == ["fake", "true", None]


def test_escapes_and_titles(spark):
    assert values(spark, [r"a\nb\tc"], tx.repair_escapes("a")) == ["a\nb c"]
    assert values(spark, [r"a\nb\tc"], tx.escape_count("a")) == [2]
    rows = ["Um. Dois tres", "sem ponto", "Fim."]
    assert values(spark, rows, tx.drop_first_sentence("a")) == ["Dois tres", "sem ponto", "Fim."]
    assert values(spark, ["T\ncorpo\nx", "só"], tx.drop_first_line("a")) == ["corpo\nx", "só"]


def test_domain_and_outlet(spark):
    assert values(spark, ["https://www.g1.globo.com/x", "nada"], tx.domain("a")) == ["g1.globo.com", None]
    rows = ["www1.afolhabrasil.com.br", "g1.globo.com", "x.org", None]
    assert values(spark, rows, tx.outlet("a")) == ["afolhabrasil", "g1", "outros_true", "outros_true"]


def test_kinds(spark):
    long_quote = "“" + " ".join(["p"] * 20) + "” resto"
    short_quote = "“" + " ".join(["p"] * 19) + "” resto"
    rows = [("fake", long_quote), ("fake", short_quote), ("fake", "isso é falso"), ("true", long_quote)]
    df = spark.createDataFrame(rows, "label string, t string")
    df = df.select("label", tx.quoted_lead("t").alias("quote"), tx.mentions("t").alias("m"))
    got = [r[0] for r in df.select(tx.text_kind("label", "quote", "m")).collect()]
    assert got == [fx.KIND_QUOTED, fx.KIND_OTHER, fx.KIND_CHECK, fx.KIND_TRUE]


def test_mentions_are_whole_words(spark):
    rows = ["viralizou ontem", "infalso", "é falsa.", "desmentida", "notícia"]
    assert values(spark, rows, tx.mentions("a")) == [True, False, True, True, False]
    assert values(spark, ["  Vídeo mostra", "O vídeo", "fotomontagem"], tx.opens_with("a")) == [True, False, True]


def test_bands(spark):
    got = values(spark, [0, 19, 20, 29, 30, 49, 50, 51], tx.length_band("a"), "a int")
    assert got == [None, "<20", "20-29", "20-29", "30-49", "30-49", "50", None]
    assert values(spark, [0.19, -0.2, 0.6], tx.certainty_band("a"), "a double") == ["doubt", "moderate", "high"]
    assert values(spark, [0.0, -0.1], tx.score_to_label("a"), "a double") == ["true", "fake"]


def test_years_and_dates(spark):
    rows = [("em 01/02/2020", None), ("99/99/2020", "http://x/2021/y"), (None, None)]
    df = spark.createDataFrame(rows, "d string, u string")
    assert [r[0] for r in df.select(dates.publication_year("d", "u")).collect()] == [2020, 2021, None]
    texts = ["Wed, 30 Sep 2026 14:03:00 -0300", "2026-09-30 17:03:00", "ontem", None]
    got = values(spark, texts, F.unix_timestamp(dates.parse_mixed("a")))
    want = int(datetime.datetime(2026, 9, 30, 17, 3, tzinfo=datetime.timezone.utc).timestamp())
    assert got == [want, want, None, None]


def test_padded_grams(spark):
    rows = values(spark, ["a", "urg"], ngrams.char_ngrams("a", 2, 5))
    assert rows[0] == [" a", "a ", " a "]
    assert rows[1] == [" u", "ur", "rg", "g ", " ur", "urg", "rg ", " urg", "urg ", " urg "]


def test_tokens_and_runs(spark):
    assert values(spark, ["É a já notícia_2!"], ngrams.word_tokens("a")) == [["já", "notícia_2"]]
    assert values(spark, ["aa bb cc"], ngrams.word_ngrams("a", 1, 2)) == [["aa", "bb", "cc", "aa bb", "bb cc"]]
    got = values(spark, ["bb aa bb"], ngrams.run_lengths(ngrams.word_tokens("a")))[0]
    assert [(r.term, r.tf) for r in got] == [("aa", 1), ("bb", 2)]
    assert values(spark, [""], ngrams.run_lengths(ngrams.word_tokens("a"))) == [[]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("R$ 3,5", {"money": 1}),
        ("5%", {"percent": 1}),
        # The phrase makes "10" a percentage; "cento" is also a number word of its own.
        ("10 por cento", {"percent": 1, "spelled": 1}),
        ("2026", {"year": 1}),
        ("2026%", {"percent": 1}),
        ("14h30", {"time_or_date": 1}),
        ("(1º)", {"time_or_date": 1}),
        ("12", {"other_digit": 1}),
        ("dois,", {"spelled": 1}),
        ("um", {}),
    ],
)
def test_number_classes(spark, text, want):
    got = values(spark, [text], numbers.number_counts("a"))[0].asDict()
    assert {k: got[k] for k in fx.NUMBER_CATEGORIES if got[k]} == want
    assert got["n_numbers"] == sum(want.values())


def test_smoothed_rate(spark):
    got = values(spark, [1], numbers.smoothed_rate(F.col("a"), F.lit(8), F.lit(0.05)), "a int")[0]
    assert got == pytest.approx(2 / 28)


def test_readable_grams(spark):
    assert values(spark, [" ab\x01"], tx.readable_gram("a")) == ["·ab?"]
    assert values(spark, ["M | sem X no treino"], tx.split_name("a", drop=" no treino").getField("scenario")) == ["sem X"]


def test_page_rules(spark):
    html = """<html><blockquote class="twitter-tweet">rede social aqui agora sim</blockquote>
    <blockquote>@alguem disse isso tudo</blockquote><blockquote><p>"Versão 1: o boato</p> em texto"</blockquote></html>"""
    blocks = values(spark, [html], pages.quoted_blocks("a"))[0]
    assert len(blocks) == 1
    assert values(spark, [html], pages.longest_quote(pages.quoted_blocks("a"))) == ["o boato em texto"]
    page = """<title>Manchete</title><article><h1>Manchete</h1><p>Leia mais aqui</p><p>Praça — Foto: Fulano</p>
    <p>Por Ana, g1 30/09/2026 14h03 Atualizado há 2h O texto começa</p><p>• e segue.</p></article>"""
    lead = pages.lead_of_lines(pages.body_lines("a"), pages.page_title("a"))
    assert values(spark, [page], lead) == ["O texto começa e segue."]
    assert values(spark, ["<p>x</p>"], pages.longest_quote(pages.quoted_blocks("a"))) == [""]


def test_entity_masking_joins_spaces(spark):
    token = "text string, pos string, ent_type string, ent_iob string, like_num boolean, ws string"
    toks = [("João", "PROPN", "PER", "B", False, " "), ("Silva", "PROPN", "PER", "I", False, " "),
            ("viu", "VERB", "", "O", False, " "), ("2", "NUM", "", "O", True, " "), ("globo", "NOUN", "", "O", False, "")]
    df = spark.createDataFrame([(toks,)], f"tokens array<struct<{token.replace(' ', ': ').replace(',:', ',')}>>")
    got = df.select(masking.mask_level("tokens", 2), masking.mask_reinforced("tokens")).collect()[0]
    assert got[0] == "ENTPER viu NUM FONTE"
    assert got[1] == "ENT ENT viu NUM FONTE"


def test_leak_guard():
    with pytest.raises(ValueError):
        tx.assert_no_leaks(["text", "author"])


def test_grams_of_short_and_long_words(spark):
    def plain(text, lo, hi):
        padded = [f" {w} " for w in text.lower().split()]
        return [w[i : i + n] for w in padded for n in range(lo, max(lo, min(hi, len(w))) + 1) for i in range(max(len(w) - n + 1, 1))]

    rows = ["a Bc " + "x1é😀" * 9 + " fim", "q" * 22 + " " + "q" * 23, "", "  "]
    for lo, hi in ((2, 5), (3, 5), (5, 5), (2, 30)):
        assert values(spark, rows, ngrams.char_ngrams("a", lo, hi)) == [plain(t, lo, hi) for t in rows]
    assert values(spark, [None], ngrams.char_ngrams("a")) == [None]


def test_grams_are_copied_twice_at_most(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("a")).select(ngrams.char_ngrams("a"))
    plan = plan._jdf.queryExecution().analyzed().toString()
    at, depth, levels = plan.index("substring("), 0, 0
    for i in range(at - 1, -1, -1):
        depth += {")": -1, "(": 1}.get(plan[i], 0)
        if depth == 1:
            levels += plan[: i].endswith("lambdafunction")
            depth = 0
    assert levels == 2


@pytest.mark.parametrize("name", ["mask_by_lexicon", "mask_by_annotation", "style_ratios"])
def test_tokens_are_made_once(spark, folder, name):
    from textsieve.plans.catalog import all_queries

    plan = all_queries()[name].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_extract_all" in line for line in filters)
