"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the dark wood tonight again"

DOCS = [
    (1, f"{SENTENCE}. Mail me: a.b@c.example.org or call +49 (30) 123-4567 now", "en"),
    (2, f"{SENTENCE}. Mail me: a.b@c.example.org or call +49 (30) 123-4567 now", "en"),
    (3, SENTENCE.upper(), "en"),
    (4, None, "en"),
    (5, "", "de"),
    (6, " \t\n\x0b\f\r ", None),
    (7, LONG, "en"),
    (8, "der schnelle braune Fuchs springt über den faulen Hund und läuft nachts durch den Wald davon", "de"),
    (9, "1234 !!! ---", "de"),
    (None, "a text without an id", None),
    (11, "é" * 500 + " <turn user> \\n </turn> 4111 1111 1111 1111", "fr"),
    (12, "same line\nsame line\nsame line\n\nother", "en"),
    (12, "same line\nsame line\nsame line\n\nother", "en"),
    (13, f"intro words here {SENTENCE} and an outro", "en"),
    (14, "x", "en"),
]

CLASHING = ("id", "key", "row", "digest", "text_", "_text", "fp", "node", "component", "score", "lang_pred", "word", "spans", "hash", "size", "kept")


def docs(spark: SparkSession, rows=None, clashing: bool = True) -> DataFrame:
    rows = DOCS if rows is None else rows
    df = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"extra-{c}").alias(c) for c in CLASHING]) if clashing else df


def empty(spark: SparkSession, clashing: bool = True) -> DataFrame:
    return docs(spark, [], clashing)


def sentences(seed: int, n: int, length: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(length)) for _ in range(n)]


def edited(text: str, changes: int, seed: int) -> str:
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)
