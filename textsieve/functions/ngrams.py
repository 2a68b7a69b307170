"""Tokens, word n-grams and padded character n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD_CHAR, _col, let, words


def word_tokens(c, lowercase: bool = True) -> Column:
    """Runs of two or more word characters."""
    subject = F.lower(_col(c)) if lowercase else _col(c)
    return F.regexp_extract_all(subject, F.lit(rf"{WORD_CHAR}{{2,}}"), F.lit(0))


def _grams_of(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i - 1 + k) for k in range(n)]))


def word_ngrams(c, lo: int = 1, hi: int = 1, lowercase: bool = True) -> Column:
    toks = word_tokens(c, lowercase)
    if (lo, hi) == (1, 1):
        return toks
    return let(toks, lambda t: F.concat(*[_grams_of(t, n) for n in range(lo, hi + 1)]))


def _places(lo: int, hi: int, length: int, unit: int) -> list[int]:
    """Start and length of every gram of a padded word, as ``unit * start + length``, shorter grams first."""
    sizes = range(lo, max(lo, min(hi, length)) + 1)
    return [unit * start + n for n in sizes for start in range(1, max(length - n + 1, 1) + 1)]


#: Padded words up to this length find their grams' places in a table; for longer ones they are reckoned.
TABLE_LENGTH = 24


def char_ngrams(c, lo: int = 2, hi: int = 5, lowercase: bool = True) -> Column:
    """Character n-grams that never cross a word border, those of a word with a space on both sides, shorter lengths first.

    Every array level copies all strings below it, so grams are made at the second level, from numbers.
    """
    subject = F.lower(_col(c)) if lowercase else _col(c)
    padded = F.transform(words(subject), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    bits = max(lo, hi).bit_length()
    unit = 1 << bits
    table = F.array(*[F.array(*[F.lit(x) for x in _places(lo, hi, n, unit)]) for n in range(TABLE_LENGTH + 1)])

    def reckoned(length: Column) -> Column:
        sizes = F.sequence(F.lit(lo), F.greatest(F.lit(lo), F.least(F.lit(hi), length)))
        starts = lambda n: F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda p: unit * p + n)))

    def grams(p: Column) -> Column:
        places = F.when(F.length(p) <= TABLE_LENGTH, F.get(table, F.length(p))).otherwise(reckoned(F.length(p)))
        return F.transform(places, lambda x: F.substring(p, F.shiftright(x, bits), x.bitwiseAND(F.lit(unit - 1))))

    return F.flatten(F.transform(padded, grams))


def run_lengths(terms: Column) -> Column:
    """``array<struct<term, tf>>`` from an array of terms: sort, mark run starts, subtract.

    Counting happens inside the row, so long form needs no shuffle on (document, term).
    """

    def between_starts(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - at).cast("long").alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), between_starts)
