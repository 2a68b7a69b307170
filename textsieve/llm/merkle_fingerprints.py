"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of a text.

A text is cut, without losing a byte, into *pieces* (some words; a cut depends on the four bytes before it only),
*paragraphs* (lines) and *sections* (runs of paragraphs that end at an empty line, or at a paragraph whose hash says
so). A piece's hash covers its bytes, that of a paragraph the hashes of its pieces, and so on up to the root. As every
cut depends on nearby content alone, an edit changes the branches it touches and no others.

Equal roots are equal texts. Two trees are compared from the root downwards: equal branches are done, and only the
children of differing ones are looked at, so likeness and the places of edits come without reading any text.

A fingerprint is the tree as a string: the root in 22 characters of base64, then a ``;`` before each section (8
characters), a ``,`` before each paragraph (8) and 4 for each piece. Hashes are cut to 24 bits in pieces and 48 above;
the root has 128. An empty text has a root and no section.

Defined cases: a null text counts as empty; texts are read whole, one at a time; repeated rows have equal fingerprints;
the next document of a row is that of the next larger id (ids null come last, equal ids in the order of a hash of their
texts), and for the last row the first one, which may be the row itself; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: One in so many ends of words, and ends of characters inside unspaced runs, ends a piece.
WORDS_PER_PIECE = 4
CHARS_PER_PIECE = 64
#: Bytes of text that one task reads, about.
RUN_BYTES = 1 << 26
#: One in so many paragraphs ends a section.
PARAGRAPHS_PER_SECTION = 16

_ROOT, _BRANCH, _PIECE = 22, 8, 4
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the pieces of a text, and which of them end a paragraph, and which an empty line."""
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    rolled = np.zeros(n, dtype=np.uint32)
    wide = b.astype(np.uint32)
    for k in range(4):
        rolled[k:] += (wide[: n - k] + np.uint32(1)) * _FACTORS[k]
    rolled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(12)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    # a cut behind byte i; the next byte must start a character, and a run of spaces stays together
    cut = np.zeros(n, dtype=bool)
    word_end = space[:-1] & ~space[1:] if n else cut
    before = np.zeros(n, dtype=np.uint32)
    before[1:] = rolled[:-1]
    cut[:-1] = word_end & (before[:-1] % np.uint32(WORDS_PER_PIECE) == 0)
    starts = (b[1:] & 0xC0) != 0x80
    cut[:-1] |= starts & ~space[:-1] & ~space[1:] & (rolled[:-1] % np.uint32(CHARS_PER_PIECE) == 1)
    newline = b == 10
    line = np.zeros(n, dtype=bool)
    line[:-1] = newline[:-1] & ~newline[1:]
    blank = np.zeros(n, dtype=bool)
    blank[1:] = line[1:] & newline[:-1]
    cut |= line
    if n:
        cut[-1] = line[-1] = True
    ends = np.flatnonzero(cut)
    return ends + 1, line[ends], blank[ends]


def _text(digest: bytes, chars: int) -> str:
    return b64encode(digest[: (chars * 6 + 7) // 8]).decode()[:chars]


def fingerprint(text: str | None) -> str:
    """The tree of a text as a string."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hashed = hashlib.blake2b
    if not data:
        return _text(hashed(b"", digest_size=17).digest(), _ROOT)
    ends, lines, blanks = cuts(data)
    pieces, at = [], 0
    for end in ends.tolist():
        pieces.append(hashed(data[at:end], digest_size=12).digest())
        at = end
    out, roots, section, section_out, first = [], [], [], [], 0
    last = len(pieces) - 1
    for end in np.flatnonzero(lines).tolist():
        own = pieces[first : end + 1]
        digest = hashed(b"".join(own), digest_size=12, person=b"paragraph").digest()
        section.append(digest)
        leaves = b64encode(b"".join([p[:3] for p in own])).decode()
        section_out.append("," + _text(digest, _BRANCH) + leaves)
        first = end + 1
        if blanks[end] or end == last or digest[-1] % PARAGRAPHS_PER_SECTION == 0:
            top = hashed(b"".join(section), digest_size=12, person=b"section").digest()
            roots.append(top)
            out.append(";" + _text(top, _BRANCH) + "".join(section_out))
            section, section_out = [], []
    return _text(hashed(b"".join(roots), digest_size=17, person=b"root").digest(), _ROOT) + "".join(out)


def tree(print_: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections of a fingerprint: name and paragraphs, of which each has a name and its pieces."""
    sections = []
    for part in print_[_ROOT + 1 :].split(";") if len(print_) > _ROOT else ():
        name, *paragraphs = part.split(",")
        sections.append((name, [(p[:_BRANCH], [p[k : k + _PIECE] for k in range(_BRANCH, len(p), _PIECE)]) for p in paragraphs]))
    return sections


def _pieces(branch) -> int:
    return len(branch[1]) if isinstance(branch[1][0], str) else sum(_pieces(b) for b in branch[1])


def _unmatched(one: list, two: list) -> tuple[int, list, list]:
    """Pieces in branches both sides have, and the branches of each side that the other has not (repeats counted)."""
    names = Counter(b[0] for b in one) & Counter(b[0] for b in two)
    left, right, common = dict(names), dict(names), 0
    rest: tuple[list, list] = ([], [])
    for side, budget, branches in ((0, left, one), (1, right, two)):
        for branch in branches:
            if budget.get(branch[0], 0):
                budget[branch[0]] -= 1
                common += _pieces(branch) if side == 0 else 0
            else:
                rest[side].append(branch)
    return common, *rest


def likeness(one: str, two: str) -> float:
    """Share of pieces in common, twice their number over that of both texts; 1 for equal roots.

    Branches of equal hash are counted whole; only children of differing ones are compared.
    """
    if one[:_ROOT] == two[:_ROOT]:
        return 1.0
    if min(len(one), len(two)) == _ROOT:
        return 0.0
    a, b = tree(one), tree(two)
    total = sum(map(_pieces, a)) + sum(map(_pieces, b))
    common, a, b = _unmatched(a, b)
    more, a, b = _unmatched([p for s in a for p in s[1]], [p for s in b for p in s[1]])
    pieces = Counter(x for p in a for x in p[1]) & Counter(x for p in b for x in p[1])
    return 2.0 * (common + more + pieces.total()) / total


def differences(one: str, two: str) -> list[tuple[int, int, int]]:
    """Places of edits: (section, paragraph, piece), from 0, of the pieces of ``one`` that ``two`` does not have.

    Only differing branches are opened.
    """
    if one[:_ROOT] == two[:_ROOT]:
        return []
    sections = [(name, (at, branch)) for at, (name, branch) in enumerate(tree(one))]
    other = tree(two)
    names = Counter(b[0] for b in other) & Counter(s[0] for s in sections)
    open_one, open_two, used = [], [], Counter()
    for name, (at, paragraphs) in sections:
        used[name] += 1
        if used[name] > names[name]:
            open_one += [(at, k, p) for k, p in enumerate(paragraphs)]
    used = Counter()
    for name, paragraphs in other:
        used[name] += 1
        if used[name] > names[name]:
            open_two += paragraphs
    names = Counter(p[0] for p in open_two) & Counter(p[0] for _, _, p in open_one)
    left, right = Counter(names), Counter(names)
    one_rest, two_rest = [], Counter()
    for at, k, p in open_one:
        if left[p[0]]:
            left[p[0]] -= 1
        else:
            one_rest += [(at, k, j, x) for j, x in enumerate(p[1])]
    for p in open_two:
        if right[p[0]]:
            right[p[0]] -= 1
        else:
            two_rest.update(p[1])
    out = []
    for at, k, j, x in one_rest:
        if two_rest[x]:
            two_rest[x] -= 1
        else:
            out.append((at, k, j))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``into``; a column of that name is replaced."""
    plain = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() != into.lower()])
    schema = StructType([*plain.schema.fields, StructField(into, StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return plain.mapInArrow(go, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed_pieces long, first_change string"


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    new_mark = mark if new == text else fingerprint(new)
    changed = differences(mark, new_mark)
    first = ".".join(map(str, changed[0])) if changed else None
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark), len(changed), first)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
_COLUMNS = [f.split()[0] for f in _RESULT.split(", ")]


def _batches(rows: Iterator[tuple], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size > 1 << 23 or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def run_starts(keys: DataFrame, runs: int) -> list[tuple]:
    """First key (id is null, id, hash) of each of about ``runs`` runs of equal size, in order: a row for every run."""
    laid = keys.repartitionByRange(runs, "none", "doc_id", "hash").withColumn("run", F.spark_partition_id())
    firsts = laid.groupBy("run").agg(F.min(F.struct("none", "doc_id", "hash")).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in firsts)


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and the likeness to that and to the next document.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``changed_pieces`` (pieces of the text that the edited one has not) and ``first_change`` (section, paragraph and
    piece of the first of them). Ids are cut in runs of ``RUN_BYTES`` of text, of which the driver knows the first
    keys only. Each text travels once to its run, the first one of a run also to the run before (of the first run: to
    the last). A task reads a run in order and holds two texts.
    """
    value = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    row_id = docs[f"`{key}`"].cast("long")
    rows = docs.select(row_id.isNull().alias("none"), F.coalesce(row_id, F.lit(0)).alias("doc_id"), F.xxhash64(value).alias("hash"), value.alias("text"))
    spark = docs.sparkSession
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    starts = run_starts(rows.drop("text"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // RUN_BYTES))
    if not starts:
        return spark.createDataFrame([], _RESULT)

    @F.pandas_udf("array<struct<run:int,guest:boolean>>")
    def places(none: pd.Series, doc_id: pd.Series, hashed: pd.Series) -> pd.Series:
        out = []
        for row in zip(none.tolist(), doc_id.tolist(), hashed.tolist(), strict=True):
            run = bisect_right(starts, row) - 1
            own = [{"run": run, "guest": False}]
            out.append([*own, {"run": (run or len(starts)) - 1, "guest": True}] if row == starts[run] else own)
        return pd.Series(out)

    dealt = rows.withColumn("place", F.explode(places("none", "doc_id", "hash"))).select("place.run", "place.guest", "none", "doc_id", "hash", "text")
    laid = dealt.repartition(len(starts), "run").sortWithinPartitions("run", "guest", "none", "doc_id", "hash")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            before, at = None, None
            for batch in batches:
                for run, guest, none, doc_id, body in zip(*batch.columns, strict=True):
                    run, guest = run.as_py(), guest.as_py()
                    if run != at:
                        before, at = None, run
                    elif before is None:
                        continue  # equal first rows are all guests; one is enough
                    body = body.as_py()
                    mark = fingerprint(body)
                    if before is not None:
                        yield _row(*before, body, mark)
                    before = None if guest else (None if none.as_py() else doc_id.as_py(), body, mark)

        yield from _batches(found(), _COLUMNS, _TYPES)

    return laid.select("run", "guest", "none", "doc_id", "text").mapInArrow(go, _RESULT)
