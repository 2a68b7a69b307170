"""Column expressions over text. All of them stay inside the JVM; none adds a shuffle.

Whitespace follows Unicode plus the four ASCII separators 0x1C-0x1F; word characters are
letters, numbers and the underscore in any script.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fx

SPACE = r"[\s\x1C-\x1F]"
SOLID = r"[^\s\x1C-\x1F]"
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body`` (a lambda over columns)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_label(c, renames: dict[str, str] | None = None) -> Column:
    label = F.lower(strip(_col(c).cast("string")))
    out = label
    for old, new in (renames or {"false": "fake"}).items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def clean_text(c) -> Column:
    """Drop byte-order marks, collapse runs of whitespace, trim."""
    return F.trim(F.regexp_replace(F.translate(_col(c), "\ufeff", ""), rf"(?U){SPACE}+", " "))


def code_to_label(c, codes: dict[int, str] | None = None) -> Column:
    codes = codes or {1: "fake", 0: "true"}
    out = None
    for code, label in codes.items():
        out = F.when(_col(c) == code, label) if out is None else out.when(_col(c) == code, label)
    return out


def words(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(rf"(?U){SOLID}+"), F.lit(0))


def word_count(c) -> Column:
    return F.coalesce(F.regexp_count(_col(c), F.lit(rf"(?U){SOLID}+")), F.lit(0))


def first_words(c, n: int) -> Column:
    """The first ``n`` words joined by single spaces.

    The pattern stops reading at word ``n``; the tail of a long text is never tokenised.
    """
    if n < 1:
        return F.lit("")
    head = rf"(?U)^{SPACE}*((?:{SOLID}+{SPACE}+){{0,{n - 1}}}{SOLID}+)"
    return F.regexp_replace(F.regexp_extract(_col(c), head, 1), rf"(?U){SPACE}+", " ")


def excerpt(c, n: int = 60) -> Column:
    return first_words(c, n)


def char_count(c) -> Column:
    return F.length(_col(c))


def log_chars(c) -> Column:
    return F.log1p(F.length(_col(c)).cast("double"))


def escape_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(r"\\[nt]"))


def repair_escapes(c) -> Column:
    lines = F.regexp_replace(_col(c), r"\\r\\n|\\n|\\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"\\t", " "), "[ \t]+", " "))


def drop_first_line(c) -> Column:
    rest = strip(F.regexp_extract(strip(c), r"^[^\n]*\n([\s\S]*)$", 1))
    return F.when(rest != "", rest).otherwise(_col(c))


def drop_first_sentence(c) -> Column:
    rest = F.regexp_extract(strip(c), rf"(?sU)^.*?[.!?]{SPACE}+(.+)$", 1)
    return F.when(rest != "", rest).otherwise(_col(c))


def title_word_count(c) -> Column:
    return word_count(c) - word_count(drop_first_sentence(c))


def domain(url) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(_col(url), r"https?://(?:www\.)?([^/]+)", 1)))


def outlet(dom, keys: Sequence[str] = fx.OUTLET_KEYS, default: str = fx.OUTLET_DEFAULT) -> Column:
    """First key found inside the domain; the label is the key up to its first dot."""
    host = F.coalesce(_col(dom), F.lit(""))
    rule = None
    for key in keys:
        hit, label = host.contains(key), key.split(".")[0]
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    return F.lit(default) if rule is None else rule.otherwise(default)


def widen(vocabulary: str) -> str:
    """Make ``\\w`` in a vocabulary pattern match word characters of any script."""
    return vocabulary.replace(r"\w", WORD_CHAR)


def mentions(c, vocabulary: str = fx.CHECK_VOCABULARY, fold_case: bool = True) -> Column:
    subject = F.lower(_col(c)) if fold_case else _col(c)
    return subject.rlike(rf"(^|{NON_WORD})({widen(vocabulary)})({NON_WORD}|$)")


def opens_with(c, vocabulary: str = fx.DESCRIPTION_OPENINGS) -> Column:
    return F.lower(strip(c)).rlike(rf"^({widen(vocabulary)})({NON_WORD}|$)")


def quoted_lead(c) -> Column:
    return blank_to_null(F.regexp_extract(_col(c), '^[“"]([^\\n]+?)[”"]', 1))


def text_kind(label, quote, has_check, min_quote_words: int = 20) -> Column:
    return (
        F.when(_col(label) == "true", fx.KIND_TRUE)
        .when(word_count(quote) >= min_quote_words, fx.KIND_QUOTED)
        .when(_col(has_check), fx.KIND_CHECK)
        .otherwise(fx.KIND_OTHER)
    )


def base_text(kind, quote, text) -> Column:
    return F.when(_col(kind) == fx.KIND_QUOTED, _col(quote)).otherwise(_col(text))


def length_band(n) -> Column:
    n = _col(n)
    return (
        F.when((n > 0) & (n <= 19), "<20")
        .when((n > 19) & (n <= 29), "20-29")
        .when((n > 29) & (n <= 49), "30-49")
        .when((n > 49) & (n <= 50), "50")
    )


def per_hundred(count, base) -> Column:
    base = _col(base)
    return _col(count) / F.when(base == 0, 1).otherwise(base) * 100


def mask_digits(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"\p{Nd}", "0")


def score_to_label(score) -> Column:
    return F.when(_col(score) >= 0, "true").otherwise("fake")


def certainty_band(score) -> Column:
    size = F.abs(_col(score))
    return F.when(size < 0.2, "doubt").when(size < 0.6, "moderate").otherwise("high")


def short_input(n_words, minimum: int = 20) -> Column:
    return _col(n_words) < minimum


def split_name(c, sep: str = " | ", drop: str = "") -> Column:
    """``model | scenario`` as a struct, with a fixed phrase removed from the scenario."""
    parts = _col(c)
    scenario = F.split_part(parts, F.lit(sep), F.lit(2))
    if drop:
        scenario = F.replace(scenario, F.lit(drop), F.lit(""))
    return F.struct(F.split_part(parts, F.lit(sep), F.lit(1)).alias("model"), scenario.alias("scenario"))


def readable_gram(c) -> Column:
    shown = F.translate(_col(c), " \x93\x94", "·“”")
    return F.regexp_replace(shown, r"[\p{C}\p{Z}]", "?")


def letter_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(r"\p{L}"))


def preview(c, n: int = 300) -> Column:
    return F.substring(_col(c), 1, n)


def find_label_column(df: DataFrame, hints: Sequence[str] = ("label", "classe", "class")) -> str:
    for name in df.columns:
        if any(h in name.lower() for h in hints):
            return name
    raise ValueError("no label column")


def mean_text_lengths(df: DataFrame) -> DataFrame:
    """One row per string column with its mean length: one pass, map-side aggregated."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    means = df.agg(*[F.avg(F.coalesce(F.length(n), F.lit(0))).alias(n) for n in strings])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("mean_chars")) for n in strings])
    return means.select(F.explode(pairs).alias("p")).select("p.column", "p.mean_chars")


def find_text_column(df: DataFrame) -> str:
    top = mean_text_lengths(df).orderBy(F.desc("mean_chars"), "column").limit(1).collect()
    return top[0]["column"]


def drop_leaks(df: DataFrame, leaks: Sequence[str] = fx.LEAK_COLUMNS) -> DataFrame:
    return df.drop(*leaks)


def assert_no_leaks(columns: Sequence[str], leaks: Sequence[str] = fx.LEAK_COLUMNS) -> None:
    bad = sorted(set(columns) & set(leaks))
    if bad:
        raise ValueError(f"leak columns used as features: {bad}")
