"""Number features, embeddings, cache keys, masking and style."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed_values as fx
from ...functions import masking as mk
from ...functions import text as tx
from ...operators import metrics as me
from ...operators import numeric as nm
from ...operators import results
from ...sources.tables import documents, labelled, table
from . import sql_parts as q
from .registry import query

_SPELLED = ", ".join(f"'{w}'" for w in fx.NUMBER_WORDS)
_CLASS = rf"""CASE WHEN regexp_matches(w[i], '\p{{Nd}}') THEN CASE
        WHEN regexp_matches(w[i], '\p{{Nd}}.*%|^%') OR starts_with(lower(concat_ws(' ', w[i + 1], w[i + 2])), 'por cento') THEN 'percent'
        WHEN contains(w[i], '$') OR (i > 1 AND ends_with(w[i - 1], '$')) THEN 'money'
        WHEN regexp_matches(w[i], '^\(?(?:19|20)\p{{Nd}}{{2}}(?:{q.NON_WORD}|$)') THEN 'year'
        WHEN regexp_matches(w[i], '^\p{{Nd}}{{1,2}}(?:h\p{{Nd}}{{0,2}}|:\p{{Nd}}{{2}})(?:{q.NON_WORD}|$)')
          OR regexp_matches(w[i], '^\(?\p{{Nd}}{{1,2}}(?:º|/\p{{Nd}}{{1,2}})') THEN 'time_or_date'
        ELSE 'other_digit' END
    WHEN regexp_replace(regexp_replace(lower(w[i]), '^{q.NON_WORD}+', ''), '{q.NON_WORD}+$', '') IN ({_SPELLED}) THEN 'spelled' END"""


def _counted(ident: str, source: str, extra: str = "") -> str:
    """CTEs that end in ``counts``: one row per text with the count of every class."""
    tallies = ", ".join(f"count(*) FILTER (k = '{k}')::BIGINT AS {k}" for k in fx.NUMBER_CATEGORIES)
    keep = f", any_value({extra}) AS {extra}" if extra else ""
    carry = f", {extra}" if extra else ""
    return f"""ws AS (SELECT {ident}{carry}, {q.words('text')} AS w FROM {source}),
    ks AS (SELECT {ident}{carry}, i, {_CLASS} AS k FROM (SELECT *, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM ws)),
    counts AS (SELECT ks.{ident}{keep}, any_value(n)::BIGINT AS n_words, {tallies}, count(k)::BIGINT AS n_numbers
               FROM ks JOIN (SELECT {ident}, len(w) AS n FROM ws) z USING ({ident}) GROUP BY ks.{ident})"""


_ORDER_TEXT = """notes AS (SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'true' ELSE 'fake' END AS label,
    'R$ ' || floor(o_totalprice)::BIGINT || ' em ' || strftime(o_orderdate, '%d/%m/%Y') || ' (' || year(o_orderdate) || ') ' || o_custkey
    || CASE o_orderstatus WHEN 'O' THEN '% das 14h30 dois,' WHEN 'F' THEN ' por cento US$5 Trinta um' ELSE ' às 10:45 e 2º mil.' END AS text FROM orders)"""


def order_notes(spark, d):
    """Order rows written out as short notes, so that every class of number occurs."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority")
    ending = (
        F.when(F.col("o_orderstatus") == "O", "% das 14h30 dois,")
        .when(F.col("o_orderstatus") == "F", " por cento US$5 Trinta um")
        .otherwise(" às 10:45 e 2º mil.")
    )
    text = F.concat(
        F.lit("R$ "), F.floor("o_totalprice"), F.lit(" em "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(" ("), F.year("o_orderdate"), F.lit(") "), "o_custkey", ending,
    )
    label = F.when(F.col("o_orderpriority") < "3", "true").otherwise("fake")
    return o.select("o_orderkey", label.alias("label"), text.alias("text"))


_ALL = ", ".join(["n_words", *fx.NUMBER_CATEGORIES, "n_numbers"])


@query(
    "number_counts",
    "V12",
    f"WITH {_ORDER_TEXT}, {_counted('o_orderkey', 'notes')} SELECT o_orderkey, {_ALL} FROM counts",
)
def number_counts(spark, d):
    return nm.counted(order_notes(spark, d), "text").drop("text", "label")


@query(
    "number_counts_of_documents",
    "V12",
    f"WITH {_counted('doc_id', 'documents')} SELECT doc_id, {_ALL} FROM counts",
)
def number_counts_of_documents(spark, d):
    return nm.counted(documents(spark, d, "doc_id", "text"), "text").drop("text")


_PRIOR = ", ".join(f"sum({k}) / greatest(sum(n_words), 1)::DOUBLE AS {k}" for k in nm.COUNTED)


@query(
    "number_priors",
    "A12",
    f"""WITH {_ORDER_TEXT}, {_counted('o_orderkey', 'notes')}, p AS (SELECT {_PRIOR} FROM counts)
        SELECT {', '.join(f'round({k}, 8) AS {k}' for k in nm.COUNTED)} FROM p""",
)
def number_priors(spark, d):
    p = nm.priors(nm.counted(order_notes(spark, d), "text"))
    return p.select(*[F.round(k, 8).alias(k) for k in nm.COUNTED])


_SMOOTH = ", ".join(
    f"round((c.{k} + 20 * p.{k}) / (greatest(c.n_words, 1) + 20), 8) AS rate_{k}" for k in nm.COUNTED
)


@query(
    "number_rates",
    "V13",
    f"""WITH {_ORDER_TEXT}, {_counted('o_orderkey', 'notes')}, p AS (SELECT {_PRIOR} FROM counts)
        SELECT c.o_orderkey, c.n_numbers::DOUBLE AS count, round(c.n_numbers / greatest(c.n_words, 1)::DOUBLE, 8) AS pct,
        round(ln(1 + c.n_words), 8) AS length, {_SMOOTH} FROM counts c CROSS JOIN p""",
)
def number_rates(spark, d):
    counts = nm.counted(order_notes(spark, d), "text")
    out = counts
    for mode in ("count", "pct", "length"):
        out = nm.NumberRates(mode).transform(out).withColumnRenamed("rate", mode)
    out = nm.NumberRates("categories").fit(counts).transform(out)
    rates = [f"rate_{k}" for k in nm.COUNTED]
    return out.select("o_orderkey", "count", *[F.round(c, 8).alias(c) for c in ("pct", "length", *rates)])


_RATES = ", ".join(
    f"round(avg(100.0 * {k} / greatest(n_words, 1)), 6) AS pct_{k}" for k in ["n_numbers", *fx.NUMBER_CATEGORIES]
)


@query(
    "number_rates_by_class",
    "A11 E15",
    f"""WITH {_ORDER_TEXT}, {_counted('o_orderkey', 'notes', 'label')}
        SELECT label, round(avg(n_words), 6) AS words, round(avg(CASE WHEN n_numbers > 0 THEN 100.0 ELSE 0 END), 6) AS has_number,
        {_RATES} FROM counts GROUP BY label""",
)
def number_rates_by_class(spark, d):
    rates = descriptive_rates(nm.counted(order_notes(spark, d), "text"))
    names = [c for c in rates.columns if c not in ("o_orderkey", "label")]
    return rates.groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def descriptive_rates(counts):
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = [(F.col(k) / n * 100).alias(f"pct_{k}") for k in ["n_numbers", *fx.NUMBER_CATEGORIES]]
    has = ((F.col("n_numbers") > 0).cast("double") * 100).alias("has_number")
    return counts.select("o_orderkey", "label", F.col("n_words").alias("words"), has, *shares)


_FEATURES = ["words", "has_number", "pct_n_numbers", *[f"pct_{k}" for k in fx.NUMBER_CATEGORIES]]
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, label, {f}::DOUBLE AS score FROM r" for f in _FEATURES)


@query(
    "number_auc_by_feature",
    "E15 E9",
    f"""WITH {_ORDER_TEXT}, {_counted('o_orderkey', 'notes', 'label')},
    r AS (SELECT label, n_words AS words, CASE WHEN n_numbers > 0 THEN 100.0 ELSE 0 END AS has_number,
        {', '.join(f'100.0 * {k} / greatest(n_words, 1) AS pct_{k}' for k in ['n_numbers', *fx.NUMBER_CATEGORIES])} FROM counts),
    l AS ({_LONG}), k AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY round(score, 9))
        + (count(*) OVER (PARTITION BY feature, round(score, 9)) - 1) / 2.0 AS rk FROM l)
    SELECT feature, round((sum(CASE WHEN label = 'true' THEN rk ELSE 0 END) - p * (p + 1) / 2.0) / (p * n), 6) AS auc
    FROM k CROSS JOIN (SELECT count(*) FILTER (label = 'true')::DOUBLE AS p, count(*) FILTER (label = 'fake')::DOUBLE AS n FROM notes) z
    GROUP BY feature, p, n""",
)
def number_auc_by_feature(spark, d):
    rates = descriptive_rates(nm.counted(order_notes(spark, d), "text"))
    long = rates.unpivot(
        ["label"], [F.col(f).cast("double").alias(f) for f in _FEATURES], "feature", "score"
    ).withColumn("score", F.round("score", 9))
    areas = me.auc(long, ["feature"], "score", F.col("label") == "true")
    return areas.withColumn("auc", F.round("auc", 6))


@query(
    "unit_embeddings",
    "V15",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
        u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e)
        SELECT vec_id, i::INTEGER AS pos, round(x, 6) AS value FROM u""",
)
def unit_embeddings(spark, d):
    from ...functions.vectors import unit_length

    vecs = table(spark, d, "embeddings", "vec_id", "embedding")
    flat = vecs.select("vec_id", F.posexplode(unit_length("embedding")).alias("pos", "value"))
    return flat.withColumn("value", F.round("value", 6))


# Annotated tokens are derived from the text by rule; they stand in for a tagger's output.
_TOKENS = rf"""tok AS (SELECT doc_id, unnest(t) AS text, unnest(range(1, len(t) + 1)) AS i FROM
        (SELECT doc_id, regexp_extract_all(text, '{q.WORD}+|[^\p{{L}}\p{{N}}_\s]') AS t FROM documents)),
    p AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN 'NUM' WHEN regexp_matches(text, '^{q.NON_WORD}') THEN 'PUNCT'
        WHEN regexp_matches(text, '^\p{{Lu}}') THEN 'PROPN' WHEN length(text) <= 2 THEN 'ADP' WHEN length(text) = 3 THEN 'DET'
        WHEN length(text) <= 5 THEN 'VERB' WHEN length(text) <= 7 THEN 'NOUN' WHEN length(text) <= 8 THEN 'ADJ'
        WHEN length(text) <= 9 THEN 'ADV' ELSE 'PRON' END AS pos FROM tok),
    e AS (SELECT *, CASE WHEN pos = 'PROPN' AND length(text) >= 4 THEN 'PER' ELSE '' END AS ent_type,
        CASE WHEN pos = 'PROPN' AND length(text) % 2 = 0 THEN 'I' WHEN pos = 'PROPN' THEN 'B' ELSE 'O' END AS ent_iob,
        pos = 'NUM' AS like_num, CASE WHEN length(text) = 1 AND pos = 'PUNCT' THEN '' ELSE ' ' END AS ws,
        CASE WHEN length(text) = 5 THEN 'Sub' ELSE 'Ind' END AS mood FROM p)"""

OUTLETS, TIMES, POLITICS = ["the", "les", "der"], ["of", "que", "die"], ["and", "ion", "und"]
_IN = {n: "(" + ", ".join(f"'{w}'" for w in ws) + ")" for n, ws in (("o", OUTLETS), ("t", TIMES), ("p", POLITICS))}


def annotated(spark, d):
    token = rf"{tx.WORD_CHAR}+|[^\p{{L}}\p{{N}}_\s]"
    # a test of the text itself: one on the tokens would be pushed to the scan, and the tokens made twice
    docs = documents(spark, d, "doc_id", "text").where(F.col("text").rlike(token))

    def annotate(t):
        size = F.length(t)
        pos = (
            F.when(t.rlike("^[0-9]+$"), "NUM")
            .when(t.rlike(rf"^{tx.NON_WORD}"), "PUNCT")
            .when(t.rlike(r"^\p{Lu}"), "PROPN")
            .when(size <= 2, "ADP")
            .when(size == 3, "DET")
            .when(size <= 5, "VERB")
            .when(size <= 7, "NOUN")
            .when(size <= 8, "ADJ")
            .when(size <= 9, "ADV")
            .otherwise("PRON")
        )
        return F.struct(t.alias("text"), F.lower(t).alias("lemma"), size.alias("size"), pos.alias("pos"))

    def enrich(t):
        proper = t["pos"] == "PROPN"
        return F.struct(
            t["text"].alias("text"),
            t["lemma"].alias("lemma"),
            t["pos"].alias("pos"),
            F.when(proper & (t["size"] >= 4), "PER").otherwise("").alias("ent_type"),
            F.when(proper & (t["size"] % 2 == 0), "I").when(proper, "B").otherwise("O").alias("ent_iob"),
            F.when(t["size"] == 5, "Sub").otherwise("Ind").alias("mood"),
            (t["pos"] == "NUM").alias("like_num"),
            (~t["pos"].isin("NUM", "PUNCT")).alias("is_alpha"),
            (t["pos"] == "PUNCT").alias("is_punct"),
            F.lit(False).alias("is_stop"),
            F.lit(False).alias("is_space"),
            F.when((t["size"] == 1) & (t["pos"] == "PUNCT"), "").otherwise(" ").alias("ws"),
        )

    found = F.regexp_extract_all("text", F.lit(token), F.lit(0))
    tagged = docs.select("doc_id", "text", F.transform(found, annotate).alias("t"))
    return tagged.select("doc_id", "text", F.transform("t", enrich).alias("tokens"))


def _level(n: int) -> str:
    out = "text || ws"
    if n >= 3:
        out = f"CASE WHEN lower(text) IN {_IN['t']} THEN 'TEMPO' || ws ELSE {out} END"
    if n >= 2:
        out = f"CASE WHEN like_num THEN 'NUM' || ws WHEN lower(text) IN {_IN['o']} THEN 'FONTE' || ws ELSE {out} END"
    if n >= 1:
        out = f"CASE WHEN ent_type = 'PER' THEN CASE WHEN ent_iob = 'B' THEN 'ENTPER' || ws WHEN ws <> '' THEN chr(1) ELSE '' END ELSE {out} END"
    joined = f"string_agg({out}, '' ORDER BY i)"
    if n == 0:
        return joined
    return rf"regexp_replace(regexp_replace({joined}, '^\x01+', ''), '\s*\x01+', ' ', 'g')"


@query(
    "mask_by_lexicon",
    "P32",
    f"""WITH {_TOKENS} SELECT doc_id, md5({_level(0)}) AS level_a, md5({_level(2)}) AS level_c, md5({_level(3)}) AS level_d,
        md5(string_agg(CASE WHEN ent_type = 'PER' OR pos = 'PROPN' THEN 'ENT' WHEN like_num THEN 'NUM' WHEN lower(text) IN {_IN['o']} THEN 'FONTE'
            WHEN lower(text) IN {_IN['t']} THEN 'TEMPO' WHEN lower(text) IN {_IN['p']} THEN 'POL' ELSE text END || ws, '' ORDER BY i)) AS level_e
        FROM e GROUP BY doc_id""",
)
def mask_by_lexicon(spark, d):
    rows = annotated(spark, d)
    return rows.select(
        "doc_id",
        F.md5(mk.mask_level("tokens", 0, OUTLETS, TIMES)).alias("level_a"),
        F.md5(mk.mask_level("tokens", 2, OUTLETS, TIMES)).alias("level_c"),
        F.md5(mk.mask_level("tokens", 3, OUTLETS, TIMES)).alias("level_d"),
        F.md5(mk.mask_reinforced("tokens", OUTLETS, TIMES, POLITICS)).alias("level_e"),
    )


@query(
    "mask_by_annotation",
    "P33",
    f"""WITH {_TOKENS} SELECT doc_id, md5({_level(1)}) AS level_b,
        md5(string_agg(CASE WHEN pos IN ('PUNCT', 'ADP', 'DET', 'PRON', 'CCONJ', 'SCONJ', 'AUX', 'PART') THEN text ELSE pos END || ws, '' ORDER BY i)) AS level_f,
        md5(string_agg(pos, ' ' ORDER BY i)) AS level_g FROM e GROUP BY doc_id""",
)
def mask_by_annotation(spark, d):
    rows = annotated(spark, d)
    return rows.select(
        "doc_id",
        F.md5(mk.mask_level("tokens", 1)).alias("level_b"),
        F.md5(mk.keep_function_words("tokens")).alias("level_f"),
        F.md5(mk.pos_sequence("tokens")).alias("level_g"),
    )


def _pct(cond: str, name: str) -> str:
    return f"round(count(*) FILTER ({cond}) / greatest(count(*) FILTER (pos NOT IN ('NUM', 'PUNCT')), 1)::DOUBLE * 100, 6) AS {name}"


@query(
    "style_ratios",
    "P34",
    rf"""WITH {_TOKENS} SELECT e.doc_id, {_pct("pos = 'NOUN'", 'pct_nouns')}, {_pct("pos = 'VERB'", 'pct_verbs')}, {_pct("pos = 'ADJ'", 'pct_adjectives')},
        {_pct("pos = 'ADV'", 'pct_adverbs')}, {_pct("pos = 'PRON'", 'pct_pronouns')}, {_pct("pos = 'VERB' AND lower(e.text) IN ('poder', 'dever', 'querer')", 'pct_modal_verbs')},
        {_pct("pos = 'VERB' AND mood = 'Sub'", 'pct_subj_imp_verbs')},
        {_pct("pos NOT IN ('NUM', 'PUNCT') AND length(e.text) > 1 AND upper(e.text) = e.text AND lower(e.text) <> e.text", 'pct_words_upper')},
        round(any_value(a.n) / greatest(count(*) FILTER (pos NOT IN ('NUM', 'PUNCT')), 1)::DOUBLE, 6) AS characters_per_word
        FROM e JOIN (SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) AS n FROM documents) a USING (doc_id) GROUP BY e.doc_id""",
)
def style_ratios(spark, d):
    rows = annotated(spark, d)
    flat = rows.select("doc_id", mk.style_ratios("tokens", "text").alias("s")).select("doc_id", "s.*")
    return flat.select("doc_id", *[F.round(c, 6).alias(c) for c in flat.columns[1:]])
