"""Small fixtures: documents with nulls, blanks, ties, copies and a clashing column."""

from __future__ import annotations

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "n_words string, keeper string")  # the last two clash with the operators' own names


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def frame(spark, rows):
    """rows of (doc_id, text) as a documents table with extra columns."""
    full = [(i, t, None, "s", len(t) if t is not None else None, "x", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ODD = [(901, None), (902, ""), (903, " \n\t\n "), (904, "!!! ### ???"), (905, "a"), (None, "no id here"),
       (906, "é" * 50 + "\n" + "漢字🙂 " * 30), (907, "one two three four"), (908, "x" * 5000)]
