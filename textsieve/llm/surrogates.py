"""PII surrogates in DataFrame expressions only: detect, map with a key, check collisions, write back.

Detected: e-mail addresses, IPv4 addresses, phone and card numbers, access keys, values of passwords and
tokens, and names after a title or a known given name. Each becomes a *unit* (type, normal form); one unit has
one surrogate wherever and however it is written, so coreference holds. A surrogate is drawn from a keyed
SHA-2 stream and keeps type and format: separators, length, case and script of letters, country code of a
phone number, first digit and checksum validity of a card number, title, gender and script of a name.

Collisions are checked over all units of the corpus: no two units of a type share a surrogate and no surrogate
is itself a unit's normal form. The least unit keeps a disputed surrogate, the others draw again, until none is
disputed. Attempts above the first are exceptions, in practice few; only they are joined back, by a hash of the
text, so texts are not shuffled unless the exceptions are too large for Spark to broadcast.

Defined cases: a null text stays null, a text without entities stays as it is; repeated rows get equal
surrogates; all other columns pass through. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept

# Titles and names by gender and script, used to detect and to draw.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "г-жа", "Κα"),
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "Κος"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("f", "latin"): ("Anna", "Maria", "Laura", "Sophie", "Clara", "Elena", "Julia", "Emma", "Nina", "Alice", "Ingrid", "Paula"),
    ("m", "latin"): ("Thomas", "David", "Martin", "Lucas", "Peter", "Daniel", "Victor", "Simon", "Oscar", "Hugo", "Felix", "Robert"),
    ("n", "latin"): ("Alex", "Robin", "Kim", "Sasha", "Charlie", "Jamie", "Noa", "Sam"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Нина"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Андрей", "Виктор", "Павел"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Σοφία", "Άννα"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Πέτρος", "Πάυλος"),
    ("n", "greek"): ("Αλέξης", "Χάρις"),
}
SURNAMES = {
    "latin": ("Berger", "Lindt", "Moreau", "Castillo", "Novak", "Hansen", "Keller", "Duval", "Romero", "Winter", "Fischer", "Baxter", "Olsen", "Perrin", "Vega", "Stone"),
    "cyrillic": ("Шевченко", "Черных", "Седых", "Короленко", "Дубровых", "Гайдай"),
    "greek": ("Παππάς", "Δήμου", "Βλάχου", "Μακρή"),
}
ALPHABETS = (
    ("[0-9]", "0123456789"),
    ("[a-zß-öø-ÿ]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-ZÀ-ÖØ-Þ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[а-яё]", "абвгдежзийклмнопрстуфхцчшщыэюя"),
    ("[А-ЯЁ]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"),
    ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
)
_SECRET = r"(?:password|passwd|pwd|secret|token|api_key|apikey|access_key)\s?[=:]\s?[\"']?"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"

#: Types in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![\p{L}\p{N}_])(?=[apstAPST])(?i:" + _SECRET + r")[^\s\"']{6,}",
    "ip": r"(?<![\p{N}.])(?=[0-9])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\p{N})",
    "phone": r"(?<![\p{L}\p{N}+])(?=[0-9+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])(?=[0-9])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "name": r"(?<!\p{L})(?=[\p{Lu}г])(?:" + _TITLE + " " + _NAME + "(?: (?!" + _TITLE + " )" + _NAME + ")?|" + _GIVEN + " " + _NAME + r")(?!\p{L})",
}
#: No entity starts within a word: one look back spares all patterns most positions.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"
#: Rounds of drawing again; each leaves a small share of the disputed units.
MAX_ROUNDS = 60


def entities(text: Column) -> Column:
    """Entities of a text in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _is(entity: Column, kind: str) -> Column:
    return entity.rlike("^(?:" + PATTERNS[kind] + ")$")


def kind_of(entity: Column) -> Column:
    """Type of an entity: the first pattern that matches it whole."""
    return reduce(lambda rest, kind: F.when(_is(entity, kind), kind).otherwise(rest), reversed(list(PATTERNS)), F.lit("name"))


def _script(name: Column) -> Column:
    return F.when(name.rlike("[а-яёА-ЯЁ]"), "cyrillic").when(name.rlike("[α-ωΑ-Ωά-ώΆ-Ώ]"), "greek").otherwise("latin")


def _title(entity: Column) -> Column:
    """Title with its space; empty if there is none."""
    return F.regexp_extract(entity, "^" + _TITLE + " ", 0)


def _gender(title: Column, given: Column) -> Column:
    bare = F.rtrim(F.regexp_replace(title, r"\.", ""))
    by_title = F.when(bare.isin(*TITLES["f"]), "f").when(bare.isin(*TITLES["m"]), "m")
    known = {g: [n for (x, _), ns in GIVEN.items() if x == g for n in ns] for g in "fm"}
    return F.coalesce(by_title, F.when(given.isin(*known["f"]), "f").when(given.isin(*known["m"]), "m"), F.lit("n"))


def _secret_prefix(entity: Column) -> Column:
    return F.regexp_extract(entity, "^(?i:" + _SECRET + ")", 0)


def _country(entity: Column) -> Column:
    return F.regexp_extract(entity, r"^\+\d{1,3}", 0)


def units(entity: Column, kind: Column) -> Column:
    """What has to be replaced in an entity: one unit, or given name and surname (each null if absent).

    A unit's ``core`` is the part of its normal form that is drawn anew; ``norm`` is ``head``, core and ``tail``.
    """
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    country, title = _country(entity), _title(entity)
    words = F.split(F.substr(entity, F.length(title) + 1), " ")
    two = F.size(words) > 1
    given = F.when(two | (title == ""), F.get(words, 0))
    surname = F.when(two, F.get(words, 1)).when(title != "", F.get(words, 0))

    def unit(type_: Column | str, core: Column, head: Column | str = "", tail: Column | str = "") -> Column:
        type_, head, tail = (F.lit(x) if isinstance(x, str) else x for x in (type_, head, tail))
        return F.struct(type_.alias("type"), F.concat(head, core, tail).alias("norm"), head.alias("head"), core.alias("core"), tail.alias("tail"))

    address = F.lower(entity)
    top = F.regexp_extract(address, r"\.(?:example\.)?[^.]*$", 0)
    one = (
        F.when(kind == "email", unit("email", F.substr(address, F.lit(1), F.length(address) - F.length(top)), "", top))
        .when(kind == "key", unit("key", F.substr(entity, F.lit(5))))
        .when(kind == "secret", unit("secret", F.substr(entity, F.length(_secret_prefix(entity)) + 1)))
        .when(kind == "ip", unit("ip", entity))
        .when(kind == "phone", unit("phone", F.substr(digits, F.greatest(F.length(country), F.lit(1))), F.concat(country, F.lit(":"))))
        .otherwise(unit("card", F.substr(digits, F.lit(2), F.length(digits) - 2), F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.length(digits))))
    )
    first = F.when(given.isNotNull(), unit(F.concat(F.lit("given_"), _gender(title, given), F.lit("_"), _script(given)), F.lower(given)))
    second = F.when(surname.isNotNull(), unit(F.concat(F.lit("surname_"), _script(surname)), F.lower(surname)))
    return F.when(kind == "name", F.array(first, second)).otherwise(F.array(one))


def _draw(stream: Column, i: Column | int) -> Column:
    """The i-th number below 65,536 of a stream."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(stream, F.lit(1) + F.lit(4) * (i % 32), F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7


def _pick(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _same_format(value: Column, stream: Column) -> Column:
    """Every digit and letter drawn anew within its class; hexadecimal values stay so."""
    hexadecimal = value.rlike("^(?=.*[0-9])[0-9a-f]{8,}$")

    def one(x: Column, i: Column) -> Column:
        c, number = x["c"], x["number"]
        other = reduce(lambda rest, a: F.when(c.rlike(f"^{a[0]}$"), _pick(a[1], number)).otherwise(rest), reversed(ALPHABETS), c)
        return F.when(hexadecimal & c.rlike("^[a-f]$"), _pick("abcdef", number)).otherwise(other)

    numbered = F.transform(F.split(value, ""), lambda c, i: F.struct(c.alias("c"), _draw(stream, i).alias("number")))
    return F.array_join(F.transform(numbered, one), "")


def luhn_digit(digits: Column) -> Column:
    """Check digit for a string of digits that lacks it."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return (F.lit(10) - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10


def surrogates(found: Column, attempt_of, key: str) -> Column:
    """Surrogates of an array of units; ``attempt_of`` gives a unit's attempt.

    A later attempt draws from another stream; names get a part more. Lambdas follow each other so that every
    value is computed once.
    """
    lexicons = F.create_map(
        *[x for (g, script), names in GIVEN.items() for x in (F.lit(f"given_{g}_{script}"), F.array(*map(F.lit, names)))],
        *[x for script, names in SURNAMES.items() for x in (F.lit(f"surname_{script}"), F.array(*map(F.lit, names)))],
    )

    def with_stream(u: Column) -> Column:
        attempt = attempt_of(u)
        stream = F.sha2(F.concat_ws("\x1f", F.lit(key), u["type"], u["norm"], attempt.cast("string")), 512)
        return F.struct(u.alias("u"), attempt.alias("attempt"), stream.alias("stream"), F.try_element_at(lexicons, u["type"]).alias("names"))

    def with_core(x: Column) -> Column:
        u, stream, names = x["u"], x["stream"], x["names"]
        octet = lambda i, least, most: (F.lit(least) + _draw(stream, i) % (most - least + 1)).cast("string")
        name = F.array_join(F.transform(F.sequence(F.lit(0), x["attempt"]), lambda i: F.get(names, _draw(stream, i) % F.size(names))), "-")
        longer = F.when((x["attempt"] >= 4) & u["type"].isin("key", "secret"), F.substr(stream, F.lit(1), x["attempt"])).otherwise("")
        core = (
            F.when(names.isNotNull(), name)
            .when(u["type"] == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 255), octet(2, 0, 255), octet(3, 1, 254)))
            .otherwise(F.concat(_same_format(u["core"], stream), longer))
        )
        return F.struct(u.alias("u"), stream.alias("stream"), core.alias("core"))

    def whole(x: Column) -> Column:
        u = x["u"]
        body = F.concat(u["head"], x["core"])
        valid = luhn_digit(F.concat(u["head"], u["core"])) == u["tail"].cast("int")
        last = (luhn_digit(body) + F.when(valid, 0).otherwise(1 + _draw(x["stream"], 31) % 9)) % 10
        return F.when(u["type"] == "card", F.concat(body, last.cast("string"))).when(u.isNotNull(), F.concat(body, u["tail"]))

    return F.transform(F.transform(F.transform(found, with_stream), with_core), whole)


def _fill_digits(entity: Column, digits: Column, skip: Column) -> Column:
    """The entity with its digits, after the first ``skip`` ones, replaced in order."""

    def one(c: Column, i: Column) -> Column:
        rank = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("^[0-9]$") & (rank > skip), F.substr(digits, rank - skip, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _with_case(entity: Column, lower: Column) -> Column:
    cased = F.zip_with(F.split(lower, ""), F.split(entity, ""), lambda s, c: F.when(c.isNotNull() & (c != F.lower(c)), F.upper(s)).otherwise(s))
    return F.array_join(cased, "")


def _written(entity: Column, kind: Column, drawn: Column) -> Column:
    """An entity with the surrogates of its units in place."""
    first, second = F.get(drawn, 0), F.get(drawn, 1)
    return (
        F.when(kind == "email", _with_case(entity, first))
        .when(kind == "key", F.concat(F.lit("AKIA"), first))
        .when(kind == "secret", F.concat(_secret_prefix(entity), first))
        .when(kind == "ip", first)
        .when(kind == "phone", _fill_digits(entity, F.substring_index(first, ":", -1), F.greatest(F.length(_country(entity)) - 1, F.lit(0))))
        .when(kind == "card", _fill_digits(entity, first, F.lit(0)))
        .otherwise(F.concat(_title(entity), F.concat_ws(" ", first, second)))
    )


def _with_units(found: Column) -> Column:
    """Entities as structs of entity, type and units."""
    typed = F.transform(found, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), units(x["e"], x["kind"]).alias("units")))


def rewritten(found: Column, attempts: Column | None, key: str) -> Column:
    """Entities with their units replaced; ``attempts`` maps 'type<US>norm' to attempts above 0."""
    zero = F.lit(0)

    def attempt_of(u: Column) -> Column:
        return zero if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", u["type"], u["norm"])), zero)

    drawn = F.transform(_with_units(found), lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), surrogates(x["units"], attempt_of, key).alias("drawn")))
    return F.transform(drawn, lambda x: _written(x["e"], x["kind"], x["drawn"]))


def corpus_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct units of a corpus; equal entities are combined before they are shuffled."""
    found = docs.select(F.explode(entities(docs[f"`{text}`"])).alias("entity")).distinct()
    return found.select(F.explode(_with_units(F.array("entity"))).alias("x")).select(F.explode("x.units").alias("u")).where("u is not null").select("u.*").distinct()


def resolve(found: DataFrame, key: str) -> DataFrame:
    """``type``, ``norm``, ``attempt``, ``surrogate`` of all units, all surrogates distinct and none a normal form."""
    unit = F.array(F.struct("type", "norm", "head", "core", "tail"))
    drawing = F.get(surrogates(unit, lambda u: F.col("attempt"), key), 0)
    originals = found.select("type", F.col("norm").alias("surrogate"))
    waiting = found.withColumn("attempt", F.lit(0))
    settled = None
    for _ in range(MAX_ROUNDS):
        drawn = kept(waiting.withColumn("surrogate", drawing), "surrogates")
        first = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("norm"))
        taken = originals.select("type", F.lower("surrogate").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("type", F.lower("surrogate").alias("surrogate")))
        free = first.withColumn("low", F.lower("surrogate")).join(taken.select("type", F.col("surrogate").alias("low")), ["type", "low"], "left_anti")
        good = drawn.join(free.select("type", "norm"), ["type", "norm"], "left_semi")
        settled = good if settled is None else settled.unionByName(good)
        waiting = kept(drawn.join(good.select("type", "norm"), ["type", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("surrogate"), "disputed")
        if waiting.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` with the entities in ``text`` replaced."""
    found = kept(corpus_units(docs, text), "units")
    mapping = resolve(found, key)
    again = kept(mapping.where(F.col("attempt") > 0).select("type", "norm", "attempt"), "attempts")
    body = docs[f"`{text}`"]
    attempts = None
    names = docs.columns
    base = docs
    if not again.isEmpty():
        # units drawn again, by the texts that hold them
        held = docs.select(F.xxhash64(body).alias("text_hash"), F.explode(_with_units(entities(body))).alias("x")).select("text_hash", F.explode("x.units").alias("u")).where("u is not null")
        maps = held.select("text_hash", "u.type", "u.norm").distinct().join(again, ["type", "norm"])
        entry = F.struct(F.concat_ws("\x1f", "type", "norm").alias("key"), F.col("attempt").alias("value"))
        maps = kept(maps.groupBy("text_hash").agg(F.map_from_entries(F.collect_set(entry)).alias("attempts__")), "attempts-by-text")
        base = docs.withColumn("text_hash__", F.xxhash64(body)).join(maps.withColumnRenamed("text_hash", "text_hash__"), "text_hash__", "left")
        attempts = F.col("attempts__")
        body = base[f"`{text}`"]
    new = rewritten(entities(body), attempts, key)
    # gaps and surrogates alternate; there is one gap more
    whole = F.array_join(F.zip_with(F.split(body, ANY, -1), new, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    return base.select(*[F.when(body.isNotNull(), whole).alias(c) if c == text else base[f"`{c}`"] for c in names])
