"""Prefix trie against a plain one built in memory."""

import hashlib
import random
from zlib import crc32

import pytest

from textsieve.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())
            own.setdefault(c, []).append((order, role, text))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0][0], t[0][1] or 0, t[0][2]))] for c, v in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        childless = {p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)}
        children = sum(len(p) == len(path) + 1 for p in under)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 140), *range(202, 215), 300, 345, 777]:
        for turn in range(rng.choice((1, 2, 3, 4, 7, 9))):
            rows.append((c, turn if turn else rng.choice((None, 0)), rng.choice(("user", "assistant", None)), rng.choice(("a", "bb", "", None, "é🙂")) if turn < 4 else f"t{rng.randrange(3)}"))
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(3)]
    rows += [(500, t, "user", f"long {t % 3}") for t in range(40)] + [(501, t, "user", f"long {t % 3}") for t in range(31)]
    rows += [(600, 1, "user", "tie b"), (600, 1, "user", "tie a"), (600, 1, "user", "tie a"), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "segment", "shard", "ids"), [(1, 1024, 16_384, 512), (2, 4, 30, 2), (3, 1, 7, 3)])
def test_equal_to_plain_trie(spark, monkeypatch, seed, segment, shard, ids):
    monkeypatch.setattr(pt, "END_IDS", ids)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.of_conversations(df, segment, shard)) == brute(rows)


def test_turnless_and_empty(spark):
    bare = next(c for c in range(901, 999) if crc32(str(c).encode()) % 6 >= 3)
    rows = [(bare, 0, "user", "x"), (bare, 1, "user", "y")]
    found = got(pt.of_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert found == brute(rows) and found[0][1:6] == (0, None, 1, 0, 1)
    assert pt.of_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
