"""Small tables with every odd case: null ids and texts, empty and long texts, ties, repeated rows, further columns."""

import random

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids string, row int"


def odd_documents(spark):
    rows = [
        (1, "Plain words of a first text that stands alone here", "en", "a", 50, "x", "y", 1),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, "x", "y", 3),
        (4, " \n\t ", "en", "a", 4, "x", "y", 4),
        (5, "short", "de", "b", 5, "x", "y", 5),
        (None, "A text whose row has no id at all but words enough", "fr", "a", 50, "x", "y", 6),
        (7, LONG, "en", "a", len(LONG), "x", "y", 7),
        (8, "repeated row of this table with words", "en", "a", 37, "x", "y", 8),
        (8, "repeated row of this table with words", "en", "a", 37, "x", "y", 8),
        (9, "日本語のテキスト 🙂 ▁ \x00 é", "ja", "b", 17, "x", "y", 9),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def empty_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def sentence(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out
