"""Masking ladder and style ratios over annotated tokens.

Input is ``tokens: array<struct<text, lemma, pos, ent_type, ent_iob, mood, like_num, is_alpha,
is_punct, is_stop, is_space, ws>>`` produced upstream by a tagger. Everything here is an array
expression on that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .text import _col, let

JOINED = "\x01"


def _in(c: Column, words: Sequence[str]) -> Column:
    return F.lower(c).isin(list(words))


def mask_level(
    tokens,
    level: int,
    outlets: Sequence[str] = fx.OUTLET_WORDS,
    times: Sequence[str] = fx.TIME_WORDS,
) -> Column:
    """Levels 0 to 3: original, entities, plus numbers and outlets, plus time words.

    The inner tokens of an entity vanish; one of them with a space after it leaves one space.
    """

    def masked(t: Column) -> Column:
        out = F.concat(t["text"], t["ws"])
        if level >= 3:
            out = F.when(_in(t["text"], times), F.concat(F.lit("TEMPO"), t["ws"])).otherwise(out)
        if level >= 2:
            name = F.when(t["like_num"], "NUM").when(_in(t["text"], outlets), "FONTE")
            out = F.coalesce(F.concat(name, t["ws"]), out)
        if level >= 1:
            inner = F.when(t["ws"] != "", JOINED).otherwise("")
            entity = F.when(t["ent_iob"] == "B", F.concat(F.lit("ENT"), t["ent_type"], t["ws"])).otherwise(inner)
            out = F.when(t["ent_type"].isin(fx.ENTITY_TYPES), entity).otherwise(out)
        return out

    text = F.array_join(F.transform(_col(tokens), masked), "")
    if level == 0:
        return text
    return F.regexp_replace(F.regexp_replace(text, rf"^{JOINED}+", ""), rf"\s*{JOINED}+", " ")


def mask_reinforced(
    tokens,
    outlets: Sequence[str] = fx.OUTLET_WORDS,
    times: Sequence[str] = fx.TIME_WORDS,
    politics: Sequence[str] = fx.POLITICAL_WORDS,
) -> Column:
    """Entities and proper nouns, numbers, outlets, time and political words, token by token."""

    def masked(t: Column) -> Column:
        name = (
            F.when(t["ent_type"].isin(fx.ENTITY_TYPES) | (t["pos"] == "PROPN"), "ENT")
            .when(t["like_num"], "NUM")
            .when(_in(t["text"], outlets), "FONTE")
            .when(_in(t["text"], times), "TEMPO")
            .when(_in(t["text"], politics), "POL")
            .otherwise(t["text"])
        )
        return F.concat(name, t["ws"])

    return F.array_join(F.transform(_col(tokens), masked), "")


def keep_function_words(tokens) -> Column:
    def masked(t: Column) -> Column:
        stays = t["is_punct"] | t["is_stop"] | t["pos"].isin(fx.FUNCTION_POS)
        return F.concat(F.when(stays, t["text"]).otherwise(t["pos"]), t["ws"])

    return F.array_join(F.transform(_col(tokens), masked), "")


def pos_sequence(tokens) -> Column:
    shown = F.filter(_col(tokens), lambda t: ~t["is_space"])
    return F.array_join(F.transform(shown, lambda t: t["pos"]), " ")


def style_ratios(tokens, text) -> Column:
    """Struct of nine ratios per hundred alphabetic words (the last one per word)."""

    def ratios(ts: Column) -> Column:
        base = F.greatest(F.size(F.filter(ts, lambda t: t["is_alpha"])), F.lit(1))
        return let(base, lambda b: over(ts, b))

    def over(ts: Column, base: Column) -> Column:
        def pct(test) -> Column:
            return F.size(F.filter(ts, test)) / base * 100

        def verb(t: Column) -> Column:
            return t["pos"].isin("VERB", "AUX")

        upper = lambda t: (
            t["is_alpha"] & (F.length(t["text"]) > 1) & (F.upper(t["text"]) == t["text"])
            & (F.lower(t["text"]) != t["text"])
        )
        alnum = F.regexp_count(_col(text), F.lit(r"[\p{L}\p{N}]"))
        return F.struct(
            pct(lambda t: t["pos"] == "NOUN").alias("pct_nouns"),
            pct(verb).alias("pct_verbs"),
            pct(lambda t: t["pos"] == "ADJ").alias("pct_adjectives"),
            pct(lambda t: t["pos"] == "ADV").alias("pct_adverbs"),
            pct(lambda t: t["pos"] == "PRON").alias("pct_pronouns"),
            pct(lambda t: verb(t) & F.lower(t["lemma"]).isin(fx.MODAL_LEMMAS)).alias("pct_modal_verbs"),
            pct(lambda t: verb(t) & t["mood"].isin("Sub", "Imp")).alias("pct_subj_imp_verbs"),
            pct(upper).alias("pct_words_upper"),
            (alnum / base).alias("characters_per_word"),
        )

    return let(_col(tokens), ratios)
