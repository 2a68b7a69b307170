"""Prefix trie of conversations from vertical bitmaps.

The conversations of a shard are numbered, and an index maps each (position, turn) to the bitset of the conversations
that have this turn there. A node of the trie is a bitset: the root's holds the whole shard, and a child's is its
parent's, intersected with the postings of one turn at the next position. The walk is depth-first: the lowest
conversation left in the parent names the next posting, so every intersection yields a child. Popcounts are members,
and the intersection with the bitset of conversations that end at the depth is the node's end list.

Shards are runs of the ordered conversation ids with a bounded number of turns, so a first turn that a third of all
conversations share is one row per shard. Nodes of different shards meet by the name of their path: the exclusive or
of 128-bit hashes of (position, turn). Sums over subtrees are taken in each shard over its preorder: occurrences add up
over shards, and what counts once per distinct node is counted in the shard that holds the node's least conversation,
which holds all of its ancestors too. A conversation of very many turns is cut in segments of ``SEGMENT`` positions;
what lies below a segment is added at its last node. A hash of an end list is taken over its parts in order, in a
stream. Nothing is collected, and no group of rows is held beyond a shard or a segment.

Defined cases: turns are ordered by ``turn``, null first, those of equal ``turn`` by the MD5 of role and text; null
roles and texts are empty ones; rows without a conversation id belong to no conversation and are left out; repeated
rows are turns of their own; without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept

#: Positions of one segment of a conversation, turns of one shard.
SEGMENT = 1024
SHARD_TURNS = 16_384
#: Ids in one part of an end list.
END_IDS = 512

_NODE = "shard long, pre int, end int, up int, a long, b long, ua long, ub long, depth long, chars long, n long, least long, gross long, kind int, ends string"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``digest``, ``chars`` of every turn of a table ``(conv_id, turn, role, text)``.

    The table is sorted as a whole, so that a conversation with many turns is shared by many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    at = F.monotonically_increasing_id()
    laid = narrow.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "digest", "chars", at.alias("at"))
    laid = kept(laid.withColumn("part", F.shiftright("at", 33)), "turns")
    runs = laid.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(W.partitionBy("conv_id").orderBy("part")) - F.col("here")
    runs = runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return laid.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns after the rebuilding, and ``conv_id``, ``length`` of every conversation, also of one without turns.

    Conversation c starts with the first h turns of conversation c - c % 100, h being crc32(c) % 6, and goes on with
    its own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % 100
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= most))
    head = head.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    start = own.withColumn("h", h).withColumn("base", base).join(head, "base", "left")
    start = start.withColumn("head", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos:bigint,digest:string,chars:bigint>>)")), F.lit(1), F.col("h").cast("int")))
    start = kept(start.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "heads")
    heads = start.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", "t.pos", "t.digest", "t.chars")
    moved = start.select("conv_id", "length", (F.size("head") - F.col("h")).alias("by"))
    rest = turns.where(F.col("pos") > h).join(moved, "conv_id").select("conv_id", "length", (F.col("pos") + F.col("by")).alias("pos"), "digest", "chars")
    return heads.unionByName(rest), start.select("conv_id", "length")


def items(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation and segment: ``conv_id``, ``seg``, ``length``, name ``ta``, ``tb`` of the path above it,
    ``below`` (code points of later segments) and ``turns``, an array of (position, a, b, code points)."""
    name = [F.xxhash64(F.lit(k), "pos", "digest").alias(x) for k, x in ((1, "a"), (2, "b"))]
    seg = F.floor((F.col("pos") - 1) / segment)
    hashed = turns.select("conv_id", "length", seg.alias("seg"), "pos", "chars", *name)
    per = hashed.groupBy("conv_id", "seg").agg(
        F.first("length").alias("length"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("chars").alias("sum"),
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("turns"),
    )
    empty = lengths.where(F.col("length") == 0).select("conv_id", F.lit(0).cast("long").alias("seg"), "length")
    per = kept(per.unionByName(empty, allowMissingColumns=True), "segments")
    upto = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("conv_id").orderBy("seg").rowsBetween(1, W.unboundedFollowing)
    one, more = per.where(F.col("length") <= segment), per.where(F.col("length") > segment)
    zero = F.lit(0).cast("long")
    one = one.withColumns({"ta": zero, "tb": zero, "below": zero})
    more = more.withColumns({"ta": F.coalesce(F.bit_xor("xa").over(upto), zero), "tb": F.coalesce(F.bit_xor("xb").over(upto), zero), "below": F.coalesce(F.sum("sum").over(later), zero)})
    return one.unionByName(more).drop("xa", "xb", "sum")


class Shard:
    """Vertical bitmaps of some items of one segment, ordered by id."""

    def __init__(self, number: int, rows: list[tuple], segment: int):
        self.number, self.rows, self.segment = number, rows, segment
        self.postings: dict[tuple, int] = {}
        self.chars: dict[tuple, int] = {}
        self.ending: dict[int, int] = {}
        self.tops: dict[tuple, int] = {}
        for i, (_, seg, length, ta, tb, _, turns) in enumerate(rows):
            bit = 1 << i
            self.tops[ta, tb] = self.tops.get((ta, tb), 0) | bit
            for pos, a, b, chars in turns:
                self.postings[pos, a, b] = self.postings.get((pos, a, b), 0) | bit
                self.chars[pos, a, b] = chars
            if length <= (seg + 1) * segment:
                self.ending[length] = self.ending.get(length, 0) | bit

    def ids(self, bits: int) -> list[int]:
        raw = np.frombuffer(bits.to_bytes((len(self.rows) + 7) // 8, "little"), dtype=np.uint8)
        return [self.rows[i][0] for i in np.flatnonzero(np.unpackbits(raw, bitorder="little"))]

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_NODE`` in preorder; further rows carry more of an end list, and where an item goes on below."""
        pre = 0
        start = self.rows[0][1] * self.segment
        for (ta, tb), members in self.tops.items():
            # a node: bits, depth, name, parent's name and number, posting it came by
            stack = [(members, start, ta, tb, 0, 0, -1, None)]
            walked, ends_at, gross = [], {}, {}
            while stack:
                bits, depth, a, b, ua, ub, up, by = stack.pop()
                at = pre
                pre += 1
                walked.append((at, bits, depth, a, b, ua, ub, up, by))
                rest, children = bits & ~self.ending.get(depth, 0), []
                if depth == start + self.segment:
                    rest = 0
                while rest:
                    low = (rest & -rest).bit_length() - 1
                    pos, xa, xb, _ = self.rows[low][6][depth - start]
                    child = bits & self.postings[pos, xa, xb]
                    rest &= ~child
                    children.append((child, depth + 1, a ^ xa, b ^ xb, a, b, at, (pos, xa, xb)))
                stack.extend(reversed(children))
            for at, bits, depth, *_, up, by in reversed(walked):
                own = bits.bit_count() * self.chars[by] if by else 0
                if depth == start + self.segment:
                    own += sum(self.rows[i][5] for i in self._members(bits))
                gross[at] = gross.get(at, 0) + own
                ends_at[at] = max(ends_at.get(at, at), at)
                if up >= 0:
                    gross[up] = gross.get(up, 0) + gross[at]
                    ends_at[up] = max(ends_at.get(up, up), ends_at[at])
            for at, bits, depth, a, b, ua, ub, up, by in walked:
                ending = bits & self.ending.get(depth, 0)
                if by is None and depth:  # the top of a later segment is a node of the segment above
                    ending, kind = 0, 3
                else:
                    kind = 0
                ended = self.ids(ending) if ending else []
                least = self.rows[(bits & -bits).bit_length() - 1][0]
                chars = self.chars[by] if by else 0
                place = (self.number, at, ends_at[at], up, a, b, ua, ub, depth, chars)
                parts = [",".join(map(str, ended[k : k + END_IDS])) for k in range(0, len(ended), END_IDS)] or [None]
                yield (*place, bits.bit_count(), least, gross[at], kind, parts[0])
                for k, part in enumerate(parts[1:], 1):
                    yield (*place, 0, ended[k * END_IDS], 0, 1, part)
                if depth == start + self.segment:
                    for i in self._members(bits):
                        if self.rows[i][2] > depth:
                            yield (*place, 0, self.rows[i][0], 0, 2, None)

    def _members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


def walked(table: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Rows of ``_NODE``: kind 0 nodes of every shard, 1 further parts of end lists, 2 where an item goes on below a
    segment (``least`` its conversation), 3 tops of later segments."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, turns
            out = []
            for row in Shard(number, held, segment).nodes() if held else ():
                out.append(row)
                if len(out) == 5000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            number, held, turns = number + 1, [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if held and (turns >= shard_turns or row["seg"] != held[0][1]):
                    yield from flushed()
                steps = [(t["pos"], t["a"], t["b"], t["chars"]) for t in row["turns"] or ()]
                held.append((row["conv_id"], row["seg"], row["length"], row["ta"], row["tb"], row["below"], steps))
                turns += len(steps) + 1
        yield from flushed()

    laid = table.select("conv_id", "seg", "length", "ta", "tb", "below", "turns").orderBy("seg", "conv_id")
    return laid.mapInArrow(go, _NODE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrays = [pa.array(column, types[f.split()[1]]) for column, f in zip(zip(*rows, strict=True), _NODE.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def below(nodes: DataFrame, facts: DataFrame, segment: int) -> DataFrame:
    """``a``, ``b``, ``once`` (code points of the distinct nodes of the subtree), ``leaves``, ``gross``, ``parent``.

    ``facts`` has ``least``, ``leaf`` and ``chars`` of every distinct node. Each node's own values are added in the shard of its
    least conversation; sums over subtrees are differences of running totals over a shard's preorder.
    """
    place = ["shard", "pre", "end", "up", "a", "b"]
    kinds = nodes.where("kind in (0, 3)").select(*place, "kind", "least", "gross")
    met = kinds.join(facts.select("a", "b", F.col("least").alias("first"), "leaf", "chars"), ["a", "b"])
    node = F.col("kind") == 0
    own = node & (F.col("least") == F.col("first"))
    rows = met.select(*place, "first", "gross", F.when(own, F.col("chars")).otherwise(0).alias("once"), F.when(own, F.col("leaf").cast("long")).otherwise(0).alias("leaves"), node.alias("node"))
    # where an item goes on below its segment: what its conversation owns from there on
    part = F.floor((F.col("depth") - 1) / segment)
    per = facts.where("depth > 0").groupBy(F.col("least").alias("conv"), part.alias("seg")).agg(F.sum("chars").alias("once"), F.sum(F.col("leaf").cast("long")).alias("leaves"))
    on = nodes.where("kind = 2").select(*place, F.col("least").alias("conv"), F.floor(F.col("depth") / segment).alias("seg"))
    per = per.join(on.select("conv").distinct(), "conv", "left_semi")
    deeper = W.partitionBy("conv").orderBy(F.desc("seg")).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = on.unionByName(per, allowMissingColumns=True)
    on = both.withColumns({x: F.sum(x).over(deeper) for x in ("once", "leaves")}).where(F.col("shard").isNotNull() & F.col("once").isNotNull())
    on = on.groupBy(*place).agg(F.sum("once").alias("once"), F.sum("leaves").alias("leaves")).withColumn("node", F.lit(False))

    def go(table: pa.Table) -> pa.Table:
        pre, end, up, once, leaves, node = (table[c].to_numpy() for c in ("pre", "end", "up", "once", "leaves", "node"))
        size = int(end.max()) + 2
        sums = []
        for value in (once, leaves):
            total = np.zeros(size, dtype=np.int64)
            np.add.at(total, pre + 1, value)
            sums.append(np.cumsum(total))
        parent, known = np.zeros(size, dtype=np.int64), table["first"].is_valid().to_numpy()
        parent[pre[known]] = table["first"].fill_null(0).to_numpy()[known]
        at = np.flatnonzero(node)
        out = {c: table[c].take(pa.array(at)) for c in ("a", "b", "gross")}
        for name, total in zip(("once", "leaves"), sums, strict=True):
            out[name] = pa.array(total[end[at] + 1] - total[pre[at]])
        out["parent"] = pa.array(parent[np.maximum(up[at], 0)], mask=up[at] < 0)
        return pa.table(out)

    found = rows.unionByName(on, allowMissingColumns=True).groupBy("shard").applyInArrow(go, "a long, b long, gross long, once long, leaves long, parent long")
    return found.groupBy("a", "b").agg(F.sum("once").alias("once"), F.sum("leaves").alias("leaves"), F.sum("gross").alias("gross"), F.min("parent").alias("parent"))


def end_hashes(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``, ``sha``: SHA-256 of the ascending ids that end at a node, joined by commas.

    A list in one part is hashed as a column. Longer ones are streamed part by part, in the order of their first id.
    """
    parts = nodes.where(F.col("ends").isNotNull()).select("a", "b", "least", "kind", "ends")
    first = F.substring_index("ends", ",", 1).cast("long")
    counts = parts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("parts"), F.first("ends").alias("only"))
    short = counts.where("parts = 1").select("a", "b", F.sha2("only", 256).alias("sha"))
    long = parts.join(counts.where("parts > 1").select("a", "b"), ["a", "b"], "left_semi").select("a", "b", first.alias("first"), "ends")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], names=["a", "b", "sha"])

        for batch in batches:
            for a, b, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (a, b) != now:
                    if now is not None:
                        yield done()
                    now, state = (a, b), hashlib.sha256()
                    state.update(ends.as_py().encode())
                else:
                    state.update(b"," + ends.as_py().encode())
        if now is not None:
            yield done()

    streamed = long.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(go, "a long, b long, sha string")
    return short.unionByName(streamed)


def trie(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of conversations given as turns ``(conv_id, length, pos, digest, chars)`` and ``lengths``.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``, one row for every distinct prefix.
    """
    nodes = kept(walked(items(turns, lengths, segment), segment, shard_turns), "nodes")
    distinct = nodes.where("kind = 0").groupBy("a", "b", "depth").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("chars").alias("chars"), F.first("ua").alias("ua"), F.first("ub").alias("ub"))
    distinct = kept(distinct, "distinct-nodes")
    children = distinct.where("depth > 0").groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count(F.lit(1)).alias("children"))
    facts = distinct.join(children, ["a", "b"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    facts = kept(facts.withColumn("leaf", F.col("children") == 0), "facts")
    sums = below(nodes, facts, segment)
    nothing = hashlib.sha256(b"").hexdigest()
    joined = facts.join(sums, ["a", "b"]).join(end_hashes(nodes), ["a", "b"], "left")
    return joined.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("gross") - F.col("once")).alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )


def of_conversations(rows: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of rebuilt conversations of a table ``(conv_id, turn, role, text)``."""
    turns, lengths = rebuilt(ordered_turns(rows))
    return trie(turns, lengths, segment, shard_turns)
