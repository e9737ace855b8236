"""Odd tables and brute-force versions."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, drops int, rank string, fp int, _mark int"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and columns that clash with results."""
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "été", "straße", "zeta", "eta", "θήτα", "iota"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long = "\n".join(prose(30) for _ in range(800))
    shared = "\n".join(f"a line that many share {k}" for k in range(3))
    rows = [(i, f"{prose(20)}.\n{shared}\n{prose(5)}", draw.choice(["en", "de"]), "s", 1) for i in range(30)]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, " \n\t\n ", "en", "s", 3), (103, long, "en", "s", len(long)), (104, long, "en", "s", len(long)), (104, long, "en", "s", len(long))]
    rows += [(105, "!!! 123 ???", "en", "s", 11), (106, "x" * 50_000, "de", "s", 50_000), (None, "no id at all here", "en", "s", 5), (None, None, None, None, None), (107, "one", "en", "s", 3), (108, "One", "en", "s", 3)]
    rows += [(109, "<|endoftext|> special", "en", "s", 3), (110, "日本語 テキスト 🙂 ▁", "ja", "s", 3), (-7, "negative id", "en", "s", 3)]
    return spark.createDataFrame([(*r, 9.5, 1, "r", 2, 3) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df) -> list[dict]:
    return df.toArrow().to_pylist()
