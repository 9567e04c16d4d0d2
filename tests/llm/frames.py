"""Small frames with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = ["the", "of", "and", "idiot", "Wörter", "ño", "ção", "Änderung", "x1", "…", "don't", "it's", "MIT", "License",
         "12", "३", "漢字", "😀"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward_texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    return [None, "", " ", "\n\n", "\t x \r\n", "a" * 3000, " " * 500, "é" * 400, sentence(rng, 4000),
            *(sentence(rng, rng.randint(1, 60)) for _ in range(40)), "same text again", "same text again"]


def documents(spark, texts=None):
    """Rows (doc_id, text, and columns whose names clash with those the operators make)."""
    texts = awkward_texts() if texts is None else texts
    rows = [(k, t, k % 3, "w", 0.5, "n", "k") for k, t in enumerate(texts)]
    rows += [(None, "an id is missing", 1, None, None, None, None), (1, "", 1, "w", 0.5, "n", "k"), (5, rows[5][1], 1, "w", 0.5, "n", "k")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, pos int, words string, score double, node string, key string")


def empty(frame):
    return frame.filter("false")


def collected(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) if not isinstance(x, (list, dict)) else (True, str(x)) for x in r))
