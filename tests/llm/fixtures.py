"""Small tables with every awkward case: nulls, blanks, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, w string, "
    "text_hash long, component_id long, shard long, offset long, d string, leak string, candidates string"
)
CLASH = (0.5, "x", "y", 1, 2, 3, 4, "d", "l", "c")


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta river stone garden winter market letter bridge evening".split()) for _ in range(n))


LONG = words(1, 60_000)


def documents(spark):
    base = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "en"), (5, words(5, 40), "en"), (6, words(5, 40), "de"),
        (7, words(7, 40), "de"), (7, words(7, 40), "de"), (None, words(5, 40), None), (9, "one two three", None), (10, "1234 !!", "en"),
        (11, "x" * 50_000, "en"), (12, "éè 中文 \U0001f600 text", "fr"),
    ]
    return spark.createDataFrame([(*r, "s", 0, *CLASH) for r in base], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
