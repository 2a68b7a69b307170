"""Excerpts of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as fx
from ...functions import pages as pg
from ...functions import text as tx
from ...operators.groups import first_reason
from ...sources.tables import table
from . import sql_parts as q
from .registry import query

_BARE = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NAMES = "MAP {" + ", ".join(f"{_text(n)}: {_text(c)}" for n, c in pg.NAMED.items()) + "}"
_POINT = "CASE WHEN e[3:3] IN ('x', 'X') THEN ('0x' || e[4:-2])::INT ELSE e[3:-2]::INT END"
_READ = f"""CASE WHEN starts_with(e, '&#') THEN list_transform([{_POINT}], lambda p: CASE WHEN p = 160 THEN ' '
    WHEN p BETWEEN 1 AND 1114111 AND p NOT BETWEEN 55296 AND 57343 THEN chr(p) ELSE chr(65533) END)[1] ELSE coalesce(names[e], e) END"""


def _unescaped(c: str) -> str:
    return f"""(SELECT array_to_string(list_transform(list_zip(string_split_regex(bare, '{pg.REFERENCE}'), regexp_extract_all(bare, '{pg.REFERENCE}')),
        lambda z: z[1] || coalesce(list_transform([z[2]], lambda e: {_READ})[1], '')), '') FROM (SELECT {c} AS bare, {_NAMES} AS names))"""


def _inner(c: str) -> str:
    out = _unescaped(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({out}, '{q.SPACE}+', ' ', 'g'))"


_LEADS = rf"""src AS (SELECT page_id, {_BARE} AS h, {_inner("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS title FROM pages),
    art AS (SELECT page_id, title, coalesce(nullif(regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article\s*>', 1), ''), h) AS body FROM src),
    ln AS (SELECT page_id, title, unnest(regexp_extract_all(body, '(?is)<(?:h1|p)\b[^>]*>(.*?)</(?:h1|p)\s*>', 1)) AS raw,
           unnest(range(0, len(regexp_extract_all(body, '(?is)<(?:h1|p)\b[^>]*>(.*?)</(?:h1|p)\s*>', 1)))) AS i FROM art),
    cl AS (SELECT page_id, title, i, {_inner('raw')} AS line FROM ln),
    nn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS spot FROM cl WHERE line <> ''),
    kp AS (SELECT page_id, i, regexp_replace(line, '^[➡▶►•✅📌🔴]+\s*', '') AS line FROM nn
           WHERE NOT (spot = 1 AND lower(line) = lower(title)) AND NOT regexp_matches(line, '(?i)^(leia (?:também|mais)|veja (?:também|mais)|assista|📲|siga o|clique aqui)')
             AND NOT regexp_matches(line, '—\s*Foto:')),
    leads AS (SELECT p.page_id, {q.first_words("coalesce(string_agg(line, ' ' ORDER BY i), '')", 60)} AS excerpt
              FROM pages p LEFT JOIN kp USING (page_id) GROUP BY p.page_id)"""


@query("lead_excerpt", "X1", f"WITH {_LEADS} SELECT page_id, excerpt FROM leads")
def lead_excerpt(spark, d):
    pages = table(spark, d, "pages", "page_id", "html")
    parsed = pages.select("page_id", pg.body_lines("html").alias("lines"), pg.page_title("html").alias("title"))
    return parsed.select("page_id", pg.lead_of_lines(F.col("lines"), "title").alias("excerpt"))


@query(
    "longest_block",
    "X2 L3",
    rf"""WITH src AS (SELECT page_id, {_BARE} AS h FROM pages),
    b AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<p\b([^>]*)>(.*?)</p\s*>', 2)) AS raw,
          unnest(range(0, len(regexp_extract_all(h, '(?is)<p\b([^>]*)>(.*?)</p\s*>', 2)))) AS i FROM src),
    t AS (SELECT page_id, i, {_inner('raw')} AS t FROM b), o AS (SELECT * FROM t WHERE NOT starts_with(t, '@')),
    r AS (SELECT page_id, t, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY {q.word_count('t')} DESC, i) AS rn FROM o)
    SELECT p.page_id, coalesce(n, 0)::INTEGER AS n_blocks, coalesce({q.first_words("regexp_replace(regexp_replace(t, '^[ " + chr(34) + "“”‘’]+', ''), '[ " + chr(34) + "“”‘’]+$', '')", 60)}, '') AS excerpt
    FROM pages p LEFT JOIN (SELECT * FROM r WHERE rn = 1) z USING (page_id)""",
)
def longest_block(spark, d):
    # The pages hold no block quotes, so the same rule runs over paragraphs.
    pages = table(spark, d, "pages", "page_id", "html")
    found = pages.select("page_id", pg.quoted_blocks("html", "p").alias("blocks"))
    return found.select(
        "page_id", F.size("blocks").alias("n_blocks"), pg.longest_quote(F.col("blocks")).alias("excerpt")
    )


@query(
    "page_items_with_errors",
    "X3 F10",
    f"""WITH {_LEADS} SELECT page_id, {q.word_count('excerpt')} AS n_words, CASE WHEN NOT contains(url, '/en/') THEN 'não é /noticia/'
        WHEN excerpt = '' THEN 'sem trecho extraído' END AS error FROM leads JOIN pages USING (page_id)""",
)
def page_items_with_errors(spark, d):
    pages = table(spark, d, "pages", "page_id", "url", "html")
    lead = pg.lead_of_lines(pg.body_lines("html"), pg.page_title("html"))
    items = pages.select("page_id", "url", lead.alias("excerpt"))
    error = first_reason(
        (~F.col("url").contains("/en/"), fx.REASON_NOT_ARTICLE), (F.col("excerpt") == "", fx.REASON_NO_EXCERPT)
    )
    return items.select("page_id", tx.word_count("excerpt").cast("long").alias("n_words"), error.alias("error"))
