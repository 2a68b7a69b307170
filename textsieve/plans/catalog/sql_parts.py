"""Fragments shared by the check SQL. DuckDB uses RE2, so Unicode space is spelled out."""

from __future__ import annotations

_SPACES = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{_SPACES}]"
SOLID = f"[^{_SPACES}]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

LABELS = """labels_t AS (SELECT doc_id, CASE quality WHEN 1 THEN 'true' WHEN 0 THEN 'fake' END AS label FROM labels)"""
CORPUS = f"""{LABELS},
corpus AS (SELECT d.doc_id, d.text, d.source, l.label FROM documents d JOIN labels_t l USING (doc_id))"""


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '{SOLID}+')"


def word_count(c: str) -> str:
    return f"coalesce(len({words(c)}), 0)::BIGINT"


def first_words(c: str, n: int | str) -> str:
    return f"array_to_string({words(c)}[1:{n}], ' ')"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(c: str) -> str:
    return f"trim(regexp_replace(replace({c}, chr(65279), ''), '{SPACE}+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}{{2,}}')"


def word_bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def char_grams(c: str, lo: int, hi: int) -> str:
    """Padded character n-grams of an already lower-cased text."""
    return (
        f"flatten(list_transform({words(c)}, lambda w: flatten(list_transform("
        f"range({lo}, greatest({lo}, least({hi}, length(w) + 2)) + 1), "
        f"lambda n: list_transform(range(1, greatest(length(w) + 2 - n + 1, 1) + 1), "
        f"lambda p: substring(' ' || w || ' ', p, n))))))"
    )


def drop_first_sentence(c: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({strip(c)}, '(?s)^.*?[.!?]{SPACE}+(.+)$', 1), ''), {c})"
    )
