"""The pipeline's near-copies stage on planted edited copies."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stowage.llm import simhash
from stowage.llm.common import row_hash

from .data import rows_of
from .test_pipeline import near_brute

SCHEMA = "doc_id long, text string, lang string"


def similarity(a: str, b: str) -> float:
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted(edits: tuple[int, ...]) -> list[list[str]]:
    """Texts of 300 words, each with copies in which some words, spread evenly, are others."""
    draw, groups = random.Random(8), []
    for _ in range(25):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        group = [words]
        for n in edits:
            copy = list(words)
            for k in range(n):
                copy[300 * k // n + 150 // n] = f"edit{draw.randrange(10**9)}"
            group.append(copy)
        groups.append([" ".join(w) for w in group])
    return groups


def test_edited_copies_leave(spark):
    """One to six words of 300 edited: similarity 0.97 to 0.81."""
    groups = planted((1, 2, 3, 4, 5, 6))
    assert all(0.8 <= similarity(g[0], c) < 1 for g in groups for c in g[1:])
    docs = [(100 * i + j, c, "en") for i, g in enumerate(groups) for j, c in enumerate(g)]
    got = sorted(r["doc_id"] for r in rows_of(simhash.stage(spark, spark.createDataFrame(docs[::-1], SCHEMA), "")))
    assert got == [100 * i for i in range(len(groups))]


def test_less_alike_texts_stay(spark):
    """Eight and more words of 300 edited: similarity below 0.8, many bands shared all the same."""
    groups = planted((8, 12))
    assert all(0.5 < similarity(g[0], c) < 0.8 for g in groups for c in g[1:])
    docs = [(100 * i + j, c, "en") for i, g in enumerate(groups) for j, c in enumerate(g)]
    assert simhash.stage(spark, spark.createDataFrame(docs, SCHEMA), "").count() == len(docs)


def test_bands_meet_at_the_bound():
    draw = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        x = draw.integers(0, 1 << 64, 110, np.uint64)
        assert (simhash.bands(x[:100]) == simhash.bands(x[11:])).any()  # 89 of 110 are shared


@pytest.mark.parametrize("centres, chunk", [(0, 2048), (0, 5), (1, 2048), (2, 2048)])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, centres, chunk):
    """Groups about the bound: chains of edits, a wide group whose members are alike only in part; in any way of comparing."""
    monkeypatch.setattr(simhash.near_links, "__defaults__", (centres, chunk))
    draw = random.Random(12)
    docs, text = [], lambda ws: " ".join(ws)
    for g in range(8):
        words = [f"w{draw.randrange(3000)}" for _ in range(120)]
        for _ in range(14):  # a chain: each an edit of the one before
            docs.append(text(words))
            words = list(words)
            words[draw.randrange(len(words))] = f"e{draw.randrange(10**9)}"
        base = [f"v{draw.randrange(3000)}" for _ in range(120)]
        for _ in range(14):  # a wide group: each differs from the base by about a tenth
            other = list(base)
            for k in draw.sample(range(120), draw.randint(1, 3)):
                other[k] = f"e{draw.randrange(10**9)}"
            docs.append(text(other))
    docs += ["", None, " ", "one two", "one two", "two one", "x " * 5000, "x " * 4000]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(docs)]
    draw.shuffle(rows)
    got = rows_of(simhash.near_copies(spark.createDataFrame([(r["doc_id"], r["text"], "en") for r in rows], SCHEMA)))
    groups = near_brute(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(least for least, _ in groups) and len(groups) < len(rows) / 2


def test_rows_that_differ_in_where_a_null_is_are_two(spark):
    docs = spark.createDataFrame([(1, "some text of its own here", "x", None), (1, "some text of its own here", None, "x"), (2, "another one, of words nobody else has", "x", None), (2, "another one, of words nobody else has", "x", None)], "doc_id long, text string, a string, b string")
    assert docs.select(row_hash(docs, 1).alias("h")).distinct().count() == 3
    got = rows_of(simhash.near_copies(docs))
    assert sorted(r["doc_id"] for r in got) == [1, 2]
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_fingerprints_find_copies_without_bands(spark, monkeypatch):
    """Lightly edited long texts are linked by fingerprints and the pigeonhole, also where no two texts share a band."""
    monkeypatch.setattr(simhash, "bands", lambda found: found[:1].view("i8") ^ len(found) ^ int(found.sum() % (1 << 62)))
    draw, docs = random.Random(4), []
    for g in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(2000)]
        docs.append((10 * g, " ".join(words), "en"))
        for j in (1, 2):
            words = [*words[: 400 * j], f"edit{g}", *words[400 * j + 1 :]]
            docs.append((10 * g + j, " ".join(words), "en"))
    got = sorted(r["doc_id"] for r in rows_of(simhash.near_copies(spark.createDataFrame(docs, SCHEMA))))
    assert got == [10 * g for g in range(12)]


def test_linked_fingerprints_of_less_alike_texts_stay(spark):
    """What shares a class is held to the exact similarity: the same runs in other numbers give one fingerprint, not one set."""
    sets = spark.createDataFrame([(1, 0), (2, 31), (3, 63), (4, -1)], "mark long, fp long")
    key = {r["mark"]: r["key"] for r in rows_of(simhash.near_classes(sets, 4))}
    assert key[1] == key[2] == key[3] != key[4]
    made = lambda *x: simhash.squeeze(np.diff(np.array(x, "u8"), prepend=np.uint64(0)))
    shingled = spark.createDataFrame([(1, made(*range(1, 11))), (2, made(*range(1, 10))), (3, made(*range(8, 30)))], "mark long, set binary")
    lists = simhash.near_classes(sets.where("mark < 4"), 3).select("key", "mark")
    assert [(r["a"], r["b"]) for r in rows_of(simhash.near_links(lists, shingled))] in ([(1, 2)], [(2, 1)])
