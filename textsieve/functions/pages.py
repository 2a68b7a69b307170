"""Excerpts from web pages with column expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .text import SPACE, _col, excerpt, let, strip, word_count

#: A character reference: decimal, hexadecimal or by name.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The names of HTML 4, and the apostrophe; a no-break space is read as a space.
NAMED = {f"&{name};": chr(point) for name, point in sorted(name2codepoint.items())} | {"&apos;": "'", "&nbsp;": " "}


def _character(point: Column) -> Column:
    """Code point to character; what is none gives the replacement character."""
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(point == 0xA0, " ").otherwise(char)


def unescape(c: Column) -> Column:
    """Character references to characters, once from left to right; unknown names stay."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def read(e: Column) -> Column:
        body = F.substr(e, F.lit(3), F.length(e) - 3)
        hexadecimal = F.conv(F.substr(body, F.lit(2)), 16, 10).cast("int")
        numeric = F.when(body.rlike("^[xX]"), hexadecimal).otherwise(body.try_cast("int"))
        return F.when(F.startswith(e, F.lit("&#")), _character(numeric)).otherwise(F.coalesce(F.try_element_at(names, e), e))

    read_all = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), read)
    return F.array_join(F.zip_with(F.split(c, REFERENCE, -1), read_all, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")


def inner_text(c: Column) -> Column:
    """Markup to spaces, entities to characters, runs of space to one."""
    bare = F.regexp_replace(c, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(bare), rf"(?U){SPACE}+", " "))


def without_scripts(html) -> Column:
    return F.regexp_replace(_col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")


def blocks(html: Column, tag: str) -> Column:
    """Inner markup of every ``tag`` element, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def body_lines(html) -> Column:
    """Title heading and paragraphs of the article part of a page, as trimmed non-empty lines."""
    whole = without_scripts(html)
    article = F.regexp_extract(whole, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)
    body = F.when(article != "", article).otherwise(whole)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h1|p)\b[^>]*>(.*?)</(?:h1|p)\s*>"), F.lit(1))
    return F.filter(F.transform(found, inner_text), lambda line: line != "")


def lead_of_lines(lines: Column, title, n: int = 60) -> Column:
    """Opening of an article: title, navigation, captions and the dated byline are removed."""
    heading = F.lower(strip(title))

    def rest(all_lines: Column) -> Column:
        return F.filter(all_lines, lambda line, i: ~((i == 0) & (F.lower(line) == F.coalesce(heading, F.lit("")))))

    content = F.filter(
        let(lines, rest),
        lambda line: ~line.rlike(rf"(?iU)^({fx.NAVIGATION_OPENINGS})") & ~line.rlike(r"(?U)—\s*Foto:"),
    )
    bare = F.transform(content, lambda line: F.regexp_replace(line, rf"(?U)^[{fx.LEADING_SYMBOLS}]+\s*", ""))
    byline = (
        r"(?U)Por\s[^.]*?\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2}"
        r"(\s+Atualizado(\s+há)?\s+\S+(\s+\d{2}/\d{2}/\d{4})?)?\s*"
    )
    return excerpt(F.regexp_replace(F.array_join(bare, " "), byline, ""), n)


def page_title(html) -> Column:
    return inner_text(F.regexp_extract(_col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def longest_by_words(items: Column) -> Column:
    """Struct of the element with most words; the first one wins a tie."""
    sized = F.transform(
        items, lambda t, i: F.struct(word_count(t).alias("n"), (-i).alias("rank"), t.alias("text"))
    )
    return let(
        F.array_max(sized), lambda best: F.struct((-best["rank"]).alias("pos"), best["text"].alias("text"))
    )


def quoted_blocks(html, tag: str = "blockquote", embeds: Sequence[str] = fx.EMBED_CLASSES) -> Column:
    """Texts of quoted blocks, without social embeds and without blocks that open with a handle."""
    pattern = rf"(?is)<{tag}\b([^>]*)>(.*?)</{tag}\s*>"
    subject = without_scripts(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(subject, F.lit(pattern), F.lit(1)).alias("attributes"),
        F.regexp_extract_all(subject, F.lit(pattern), F.lit(2)).alias("inner"),
    )
    named = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_extract(p["attributes"], r"(?is)\bclass\s*=\s*[\"']([^\"']*)", 1).alias("css"),
            inner_text(p["inner"]).alias("text"),
        ),
    )
    is_embed = "|".join(embeds)
    own = F.filter(named, lambda b: ~b["css"].rlike(is_embed) & ~b["text"].startswith("@"))
    return F.transform(own, lambda b: b["text"])


def longest_quote(texts: Column, n: int = 60) -> Column:
    """Longest quoted block without version marks and edge quotes, cut to ``n`` words; '' when none."""
    chosen = longest_by_words(texts)["text"]
    unmarked = F.regexp_replace(chosen, r"(?iuU)Vers[ãa]o \d+\s*:\s*", " ")
    edges = F.regexp_replace(unmarked, "^[ \"“”'‘’]+|[ \"“”'‘’]+$", "")
    return F.coalesce(excerpt(edges, n), F.lit(""))
