"""The queries of this subpackage, one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_layout, jaccard_join, language_id, line_frequency, merkle_fingerprints, prefix_trie, quality_model
from . import sentencepiece_codec, spaced_seeds, spelling_variants, surrogates, token_counts, warc
from .tables import crc_class, read


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, component and number of links of every document under links of Jaccard 0.9 over 3-word shingles."""
    found = jaccard_join.classes(read(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "set_id", "component_id", "n_links")


#: Production passes a key of its own; this one makes test results repeatable.
SURROGATE_KEY = "textsieve surrogates"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY)


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_layout.extract(read(spark, sf_dir, "pages", "page_id", "html"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the ids is held out of learning."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").where(crc_class("doc_id", 4) != 2)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.select("doc_id", (crc_class("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out of learning."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    dictionaries = language_id.learn(docs.where(crc_class("doc_id", 3) != 1))
    found = language_id.predict(docs, dictionaries)
    return found.select("doc_id", (crc_class("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with the item: one row per contaminated pair."""
    found = spaced_seeds.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.max("matched").alias("matched"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; ``source`` is the host."""
    return line_frequency.cleaned(read(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives the text back."""
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as written to, and read back from, deduplicated archives."""
    _, records = warc.deduplicate(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded as a whole."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.of_conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses of fingerprints."""
    return merkle_fingerprints.against_next(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    found = spelling_variants.variants(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_surrogates": op2_surrogates,
    "op3_html_layout": op3_html_layout,
    "op4_quality_classifier": op4_quality_classifier,
    "op8_language_id": op8_language_id,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op6_line_frequency": op6_line_frequency,
    "op7_sentencepiece": op7_sentencepiece,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_fingerprints": op12_merkle_fingerprints,
    "op13_spelling_variants": op13_spelling_variants,
}

#: SHA-1 in base32: 40 hexadecimal digits as bits, five bits a character.
WARC_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
    SELECT page_id, strlen(body) AS payload_bytes,
        array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
            '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits
    FROM p
), r AS (
    SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
              + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
    FROM q
), s AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS lead FROM r
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM s
"""

LINE_FREQUENCY_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
    SELECT *, trim(text, E' \t\n\x0b\f\r') AS inner_text FROM d
), t AS (
    SELECT *, CASE WHEN inner_text = '' THEN [] ELSE string_split_regex(inner_text, '[\x20\x09-\x0D]+') END AS words,
        list_filter(string_split(text, E'\n'), lambda x: trim(x, E' \t\n\x0b\f\r') <> '') AS lines
    FROM w
), windows AS (
    SELECT r, i, list_slice(words, i, i + 7) AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), line AS (
    SELECT r, source, text, regexp_replace(lower(trim(raw, E' \t\n\x0b\f\r')), '[0-9]+', '0', 'g') AS line,
        len(string_split_regex(trim(raw, E' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+')) AS words
    FROM (SELECT r, source, text, unnest(lines) AS raw FROM t)
), frequent AS (
    SELECT source, line FROM line GROUP BY source, line HAVING count(DISTINCT text) > 20
), removed AS (
    SELECT r, sum(words)::BIGINT AS removed_words FROM line JOIN frequent ON line.line = frequent.line AND line.source IS NOT DISTINCT FROM frequent.source GROUP BY r
), counts AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(removed_words, 0)::BIGINT AS removed_words
    FROM t LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
), failed AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND n_words - removed_words >= 20 AND 100 * (n_words - removed_words) >= 50 * n_words AS kept FROM failed
"""



def _crc32_sql(text: str) -> str:
    """crc32 of a string in DuckDB: its bytes, each followed by eight steps of one bit."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    steps = f"flatten(list_transform({codes}, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
        WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""


PREFIX_TRIE_SQL = f"""
WITH turn AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
    SELECT conv_id, {_crc32_sql('conv_id::VARCHAR')} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM turn)
), headed AS (
    SELECT c.conv_id, c.h, coalesce((SELECT least(c.h, count(*)) FROM turn t WHERE t.conv_id = c.base), 0) AS taken, c.base FROM conv c
), built AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM headed c JOIN turn t ON t.conv_id = c.base AND t.pos <= c.taken
    UNION ALL
    SELECT c.conv_id, t.pos - c.h + c.taken, t.role, t.text FROM headed c JOIN turn t ON t.conv_id = c.conv_id AND t.pos > c.h
), listed AS (
    SELECT c.conv_id, coalesce(list(sha256(length(role)::VARCHAR || ':' || role || text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS names,
        coalesce(list(length(text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS chars
    FROM conv c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id
), path AS (
    SELECT conv_id, len(names) AS n, d, array_to_string(list_slice(names, 1, d), '') AS node, array_to_string(list_slice(names, 1, d - 1), '') AS up,
        CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars
    FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM listed)
), node AS (
    SELECT node, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
    FROM path GROUP BY node, d
), child AS (
    SELECT up AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up
), fact AS (
    SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (node)
), subtree AS (
    SELECT path.node, sum((fact.n_children = 0)::BIGINT) AS n_leaves, sum((fact.n_convs - 1) * fact.chars) AS saved_tokens
    FROM fact JOIN path ON path.conv_id = fact.conv_id AND path.d <= fact.d GROUP BY path.node
)
SELECT fact.conv_id, fact.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, fact.n_convs::BIGINT AS n_convs, fact.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, fact.ends_sha256
FROM fact JOIN subtree USING (node) LEFT JOIN fact parent ON parent.node = fact.up AND parent.d = fact.d - 1
"""

_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
#: One ASCII character for each accented letter, so that DuckDB's edit distance, which counts bytes, counts letters.
_SINGLE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~ "[: len(_ACCENTED)]

SPELLING_SQL = f"""
WITH RECURSIVE run AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), tally AS (
    SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT *, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM tally
), made AS (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n, translate(word, '{_ACCENTED}', '{_SINGLE}') AS plain FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), masked AS (
    SELECT word, n, plain, substr(plain, 1, i - 1) || '"' || substr(plain, i + 1) AS gap, 0 AS kind FROM (SELECT *, unnest(range(1, length(plain) + 1)) AS i FROM words)
    UNION SELECT word, n, plain, substr(plain, 1, i - 1) || substr(plain, i + 1), 1 FROM (SELECT *, unnest(range(1, length(plain) + 1)) AS i FROM words)
    UNION SELECT word, n, plain, plain, 2 FROM words
), near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.gap = b.gap AND a.word <> b.word
        AND ((a.kind = 0 AND b.kind = 0) OR (a.kind = 1 AND b.kind = 2) OR (a.kind = 2 AND b.kind = 1))
    WHERE levenshtein(a.plain, b.plain) = 1
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, encode(other))) AS other FROM near GROUP BY word
), formed AS (
    SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * words.n THEN other END AS form,
        CASE WHEN most >= 10 * words.n THEN most END::BIGINT AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS here, 0 AS step FROM formed
    UNION ALL SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON walk.here = formed.word WHERE formed.form IS NOT NULL
), last AS (
    SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)
"""

SQL: dict[str, str] = {"op6_line_frequency": LINE_FREQUENCY_SQL, "op9_warc": WARC_SQL, "op11_prefix_trie": PREFIX_TRIE_SQL, "op13_spelling_variants": SPELLING_SQL}
