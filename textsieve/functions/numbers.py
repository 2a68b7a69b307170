"""Number words inside a text: class of every token and counts per class, in one row expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .text import NON_WORD, let, words

# Shapes of number tokens.
PERCENT = r"\p{Nd}.*%|^%"
YEAR = rf"^\(?(?:19|20)\p{{Nd}}{{2}}(?:{NON_WORD}|$)"
HOUR = rf"^\p{{Nd}}{{1,2}}(?:h\p{{Nd}}{{0,2}}|:\p{{Nd}}{{2}})(?:{NON_WORD}|$)"
DATE = r"^\(?\p{Nd}{1,2}(?:º|/\p{Nd}{1,2})"
PERCENT_PHRASE = "por cento"


def token_class(token: Column, before: Column, after: Column, spelled: Sequence[str] = fx.NUMBER_WORDS) -> Column:
    """Class of one token given the token before it and the two tokens after it; null for plain words."""
    bare = F.regexp_replace(F.lower(token), rf"^{NON_WORD}+|{NON_WORD}+$", "")
    digits = (
        F.when(token.rlike(PERCENT) | F.lower(after).startswith(PERCENT_PHRASE), "percent")
        .when(token.contains("$") | F.coalesce(before, F.lit("")).endswith("$"), "money")
        .when(token.rlike(YEAR), "year")
        .when(token.rlike(HOUR) | token.rlike(DATE), "time_or_date")
        .otherwise("other_digit")
    )
    return F.when(token.rlike(r"\p{Nd}"), digits).when(bare.isin(list(spelled)), "spelled")


def token_classes(tokens: Column, spelled: Sequence[str] = fx.NUMBER_WORDS) -> Column:
    """Neighbours are read by position inside the array, so no shuffle and no sort is needed."""
    return let(
        tokens,
        lambda toks: F.transform(
            toks,
            lambda tok, i: token_class(
                tok,
                F.when(i > 0, F.get(toks, i - 1)),
                F.concat_ws(" ", F.get(toks, i + 1), F.get(toks, i + 2)),
                spelled,
            ),
        ),
    )


def number_counts(text, spelled: Sequence[str] = fx.NUMBER_WORDS) -> Column:
    """Struct with the word count, one count per class and their total."""

    def tally(classes: Column) -> Column:
        def n(kind: str) -> Column:
            return F.size(F.filter(classes, lambda k: k == kind)).cast("long")

        total = F.size(F.filter(classes, lambda k: k.isNotNull())).cast("long")
        return F.struct(
            F.size(classes).cast("long").alias("n_words"),
            *[n(kind).alias(kind) for kind in fx.NUMBER_CATEGORIES],
            total.alias("n_numbers"),
        )

    return let(token_classes(words(text), spelled), tally)


def smoothed_rate(count, n_words, prior, m: float = 20.0) -> Column:
    """Rate pulled towards the training rate when the text is short."""
    return (count + F.lit(float(m)) * prior) / (n_words + F.lit(float(m)))
