"""Fixtures that all training-data operators are tried on."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, toxic int, n_words string, kept_text long, node array<int>"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[k % 10]}{k}" for k in range(vocabulary)]
    out = []
    while len(out) < words:
        n = rng.randint(6, 14)
        out += [*(rng.choice(names) for _ in range(n - 1)), rng.choice(names) + "."]
    return " ".join(out[:words])


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing column names."""
    texts = [
        (1, None), (2, ""), (3, " \t\n\n "), (4, "word"), (5, "two words"), (6, prose(6, 120)), (6, prose(6, 120)), (7, prose(6, 120)),
        (None, prose(8, 90)), (None, None), (8, "x" * 200_000), (9, prose(9, 60_000)), (10, "\n".join(["the same line again and again"] * 50)),
        (11, "Ünï ΣΑΣ 日本語 😀 <|endoftext|> á   \x85 'S don't"), (12, prose(6, 118) + " other end"),
    ]
    return [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "clash", i, "n", i, [i]) for i, (d, t) in enumerate(texts)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
