"""SentencePiece encoding and decoding by streaming Viterbi.

The model file holds BPE pieces. Its segmentation of a text is the one path in which every two neighbouring
pieces, encoded alone, give themselves back: all other transitions cost minus infinity. A prefix of the text
thus has exactly one best path, and the last piece of that path is the prefix's backpointer; the backpointer
of a position depends on the positions at most ``max_piece`` characters before it. Backpointers are kept for
the characters not committed yet: as soon as the paths that survive, those from the last ``max_piece``
positions, pass through one common boundary, the ids before it are final and are committed.

Where no piece of the vocabulary spans a boundary (before a space mark that follows another character,
around a line break, between Latin letters and other characters), every path meets by construction. The text is cut there first, and the ids of a cut
are remembered in a bounded table. Ids equal those of the sentencepiece library.

Defined cases: a null text gives null ids and counts 0; an empty text gives no ids; characters unknown to
the model are written as byte pieces; a text that contains the space mark U+2581 itself cannot be told from
one with spaces, as in the library, and is reported by ``round_trip`` false. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import without

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Ways to cut a text, finest first; a model gets the first that never cuts one of its pieces.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
CUTTERS = (f"{MARK}*[{LATIN}]+|{MARK}*[^{MARK}\\n{LATIN}]+|{MARK}+|\\n", f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")
#: Cuts and piece pairs remembered by one Python worker.
REMEMBERED_CUTS = 400_000
REMEMBERED_PAIRS = 1_000_000
#: Ids per output batch at most, unless a single text has more.
BATCH_IDS = 1_000_000


def model_path(name: str = DEFAULT_MODEL) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_by_id: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_by_id.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_by_id.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.bytes_by_id.append(piece.replace(MARK, " ").encode())
        self.unknown_id = model.unk_id()
        self.max_piece = max(map(len, self.ids))
        self.prefixes: dict[str, bool] = {}  # of all pieces; true if the prefix is a piece itself
        for piece in self.ids:
            for end in range(1, len(piece)):
                self.prefixes.setdefault(piece[:end], False)
            self.prefixes[piece] = True
        self.cutter = next((c for c in map(re.compile, CUTTERS) if all(len(c.findall(p)) == 1 for p in self.ids)), None)

    def cuts(self, text: str) -> list[str]:
        """The text, marked and cut where no piece spans; joined they give the marked text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.cutter.findall(marked) if self.cutter else [marked]

    def ids_of_piece(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        raw = piece.encode("utf-8", "replace")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown_id]

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: used on two pieces at a time."""
        parts = list(text)
        scores = self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class StreamingEncoder:
    """Feed a text in parts; committed pieces come out as soon as they are certain.

    ``window`` is the number of characters held at most before convergence is looked for; never less than
    twice the longest piece. Between two looks at most another longest piece is added.
    """

    def __init__(self, vocabulary: Vocabulary, window: int = 64):
        self.vocabulary = vocabulary
        self.window = max(window, 2 * vocabulary.max_piece)
        self._fits: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._start("")

    def _start(self, before: str) -> None:
        self._text = ""  # characters since the last committed boundary
        self._last: list[str | None] = [before]  # last piece of the best path to each position
        self._next = 0  # first position from which no piece has been tried

    def _judge(self, left: str, right: str) -> bool:
        """Whether two pieces, merged as one text, give themselves back; remembered."""
        if self._pairs >= REMEMBERED_PAIRS:
            self._fits.clear()
            self._pairs = 0
        self._pairs += 1
        found = self.vocabulary.merged(left + right) == ([left, right] if left else [right])
        self._fits.setdefault(left, {})[right] = found
        return found

    def _advance(self, ready: int) -> list[str]:
        """Try all pieces from positions before ``ready``; what got committed."""
        prefixes, fits, longest = self.vocabulary.prefixes, self._fits, self.vocabulary.max_piece
        held, last, at = self._text, self._last, self._next
        size = len(held)
        last += [None] * (size + 1 - len(last))
        out: list[str] = []
        while at < ready:
            left = last[at]
            row = fits.get(left)
            if row is None:
                row = fits[left] = {}
            end = at
            while end < size:
                end += 1
                piece = held[at:end]
                whole = prefixes.get(piece)
                if whole is None and end > at + 1:
                    break
                if last[end] is None and (whole or end == at + 1):
                    fit = row.get(piece)
                    if fit is None:
                        fit = self._judge(left, piece)
                        row = fits.setdefault(left, row)
                    if fit:
                        last[end] = piece
                if whole is None:
                    break
            at += 1
            if at >= self.window and at % longest == 0 and (meet := self._meeting(at)):
                out += self._path(meet)
                held, last = held[meet:], last[meet:]
                self._text, self._last = held, last
                size -= meet
                ready -= meet
                at -= meet
        self._next = at
        return out

    def feed(self, text: str) -> list[str]:
        """Take more characters; the pieces that became certain."""
        self._text += text
        return self._advance(len(self._text) - self.vocabulary.max_piece)

    def whole(self, text: str) -> list[str]:
        """Feed a text and finish."""
        self._text = text
        return self.finish()

    def finish(self) -> list[str]:
        """The rest; the encoder is then ready for another text."""
        out = self._advance(len(self._text))
        out += self._path(len(self._text))
        self._start("")
        return out

    def _meeting(self, end: int) -> int:
        """The latest boundary that all surviving paths pass; 0 if there is none."""
        last = self._last
        alive = set(range(max(0, end - self.vocabulary.max_piece + 1), end + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            if far == 0:
                return 0
            alive.add(far - len(last[far]))
        return alive.pop()

    def _path(self, end: int) -> list[str]:
        pieces = []
        while end > 0:
            piece = self._last[end]
            pieces.append(piece)
            end -= len(piece)
        return pieces[::-1]


class _Cuts(dict):
    """Ids of cuts as bytes of int32, found by the streaming encoder when first met.

    Two generations: when the young one is full it becomes the old one, whose cuts come back when met again.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.encoder = StreamingEncoder(vocabulary)
        self.old: dict[str, bytes] = {}

    def __missing__(self, cut: str) -> bytes:
        found = self.old.get(cut)
        if found is None:
            found = self._encoded(cut)
        if len(cut) <= 64:
            if len(self) >= REMEMBERED_CUTS:
                self.old = dict(self)
                self.clear()
            self[cut] = found
        return found

    def _encoded(self, cut: str) -> bytes:
        known = self.vocabulary.ids
        ids = array("i")
        for piece in self.encoder.whole(cut):
            found = known.get(piece)
            if found is not None:
                ids.append(found)
            else:
                ids.extend(self.vocabulary.ids_of_piece(piece))
        return ids.tobytes()


class Codec:
    """Whole-text encoding and decoding with one model."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._cuts = _Cuts(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._cuts.__getitem__, self.vocabulary.cuts(text))), dtype=np.int32)

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, and the space put before a text is dropped."""
        raw = b"".join(map(self.vocabulary.bytes_by_id.__getitem__, np.asarray(ids).tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text_at: int, verify: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tool = codec(path)
    for batch in batches:
        first, parts, exact, valid, held = 0, [], [], [], 0
        texts = batch.column(text_at)
        for row in range(len(texts)):
            text = texts[row].as_py()
            ids = tool.encode(text or "")
            parts.append(ids)
            valid.append(text is not None)
            exact.append(None if text is None else (not verify or tool.decode(ids) == text))
            held += len(ids)
            if held >= BATCH_IDS or row == len(texts) - 1:
                yield _batch(batch.slice(first, row + 1 - first), parts, exact, valid, schema)
                first, parts, exact, valid, held = row + 1, [], [], [], 0


def _batch(rows: pa.RecordBatch, parts, exact, valid, schema: pa.Schema) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in parts], dtype=np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([not v for v in valid] + [False]))
    ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
    return pa.RecordBatch.from_arrays([*rows.columns[: len(schema) - 3], ids, pa.array(sizes), pa.array(exact, type=pa.bool_())], schema=schema)


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, verify: bool = True) -> DataFrame:
    """``keep`` plus ``ids`` array<int>, ``n_ids`` int and ``round_trip`` boolean of every row's whole text.

    ``round_trip`` tells whether decoding gives the text back (null for a null text; not checked, and true,
    without ``verify``). Columns of ``docs`` other than ``keep`` are left out.
    """
    path = path or model_path()
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].cast("string").alias("text__"))
    out = T.StructType(
        [rows.schema[c] for c in keep]
        + [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_ids", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                fields = [batch.schema.field(i) for i in range(len(keep))]
                schema = pa.schema([*fields, pa.field("ids", pa.list_(pa.int32())), pa.field("n_ids", pa.int32()), pa.field("round_trip", pa.bool_())])
            yield from _encoded(iter([batch]), path, len(keep), verify, schema)

    return rows.mapInArrow(run, out)


def decode(encoded: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """All columns plus the text of ``ids`` in ``into``, which replaces a column of that name; null ids give null."""
    path = path or model_path()
    base = without(encoded, into)
    rows = base.withColumn("ids__", encoded[f"`{ids}`"].cast("array<int>")) if ids.lower() != into.lower() else base
    out = T.StructType([*base.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [None if (x := lists[i].values) is None else tool.decode(x.to_numpy(zero_copy_only=False)) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, type=pa.string())], names=[*batch.schema.names[:-1], into])

    return rows.mapInArrow(run, out)
