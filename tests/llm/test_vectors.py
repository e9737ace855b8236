"""Vector searches against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stowage.llm import neighbours, topk, vectors

from .data import rows_of


def table(spark, n: int = 300, dim: int = 12):
    draw = random.Random(9)
    rows = [(i, [draw.gauss(0, 1) for _ in range(dim)], "x") for i in range(n)]
    rows += [(n + i, rows[0][1], "x") for i in range(30)] + [(20, rows[20][1], "x")]  # ties and repeated ids
    rows += [(1000, None, "x"), (1020, [], "x"), (1040, [None] * dim, "x"), (1060, [math.nan] * dim, "x"), (1080, [math.inf] * dim, "x"), (1100, [0.0] * dim, "x"), (None, [1.0] * dim, "x"), (-40, [0.5] * dim, None), (2000, [1.0] * 3, "x"), (2020, [2.0] * 3, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def brute(rows: list[dict], ints: bool, k: int = 20) -> list[tuple]:
    use = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or not v or any(x is None or not math.isfinite(x) for x in v) or not ints and not any(v):
            continue
        use.append((r["vec_id"], [math.floor(64 * x) for x in v] if ints else v))
    out = []
    for i, (q, v) in enumerate(use):
        if q % 20 == 0:
            scored = []
            for j, (c, x) in enumerate(use):
                if i != j and len(x) == len(v):
                    s = 0 if ints else 0.0
                    for a, b in zip(v, x):
                        s += a * b
                    scored.append((-s, c))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 32])
@pytest.mark.parametrize("operator, ints", [(topk.top, True), (neighbours.nearest, False)])
def test_search(spark, monkeypatch, operator, ints, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = table(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(operator(df)))
    assert got == brute(rows_of(df), ints)
    assert operator(df.limit(0)).count() == 0


def test_float_vectors(spark):
    df = table(spark).selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(neighbours.nearest(df)))
    assert got == brute(rows_of(df), False)


def test_bounds_hold():
    draw = np.random.default_rng(1)
    q, x = np.floor(64 * draw.normal(size=(9, 64))), np.floor(64 * draw.normal(size=(70, 64)))
    for level in (1, 4, 16, 32, 64):
        assert (topk.bound(q, x, level) >= q @ x.T).all()
    assert np.allclose(topk.bound(q, x, 64), q @ x.T, rtol=1e-6, atol=1)


@pytest.mark.parametrize("sparse", [0.0, 0.03, 1.0])
def test_tile_is_the_same_either_way(monkeypatch, sparse):
    """Bounds and scores by matrix product or pair by pair, on vectors of which many or few pairs fall out."""
    monkeypatch.setattr(topk, "SPARSE", sparse)
    draw = np.random.default_rng(2)
    for x in (draw.normal(size=(700, 64)), np.cumsum(draw.normal(size=(700, 64)), axis=1) / 8, np.repeat(draw.normal(size=(70, 16)), 10, axis=0)):
        at = np.arange(0, 700, 20)
        a, b, score = topk.tile(x[at], x, at, 20)
        z = np.floor(64 * x).astype(int)
        for i, q in enumerate(at):
            want = np.delete(z[q] @ z.T, q)
            got = np.sort(score[a == i])[::-1]
            assert (got[:20] == np.sort(want)[::-1][:20]).all() and q not in b[a == i]


def test_levels_take_pairs_out():
    """Smooth series fall out early, and only pairs below what a query reaches do."""
    draw = np.random.default_rng(3)
    x = np.floor(64 * np.cumsum(draw.normal(size=(2000, 64)), axis=1) / 20)
    q, alive = x[::100], np.ones((20, 2000), bool)
    shares = list(topk.prune(q, x, [topk.statistics(x, n) for n in topk.LEVELS], alive, 20))
    assert shares == sorted(shares, reverse=True) and shares[0] < 0.5 and shares[-1] < 0.1
    score = q @ x.T
    assert all(alive[i, np.argsort(-score[i])[:20]].all() for i in range(20))


def test_large_values_are_exact():
    q, x = np.full((1, 4), 2.0**40), np.array([[2.0**21, 1, 1, 1], [0, 0, 0, 3]])
    assert topk.exact(np.repeat(q, 2, 0), x).tolist() == [2**61 + 3 * 2**40, 3 * 2**40]


@pytest.mark.parametrize("operator, ints", [(topk.top, True), (neighbours.nearest, False)])
def test_no_vectors_pass_through_the_driver(spark, monkeypatch, operator, ints):
    """Many small blocks: queries repeat for every chunk of them, so a broadcast would grow with the square of the table."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "ASKED", 10, raising=False)
    monkeypatch.setattr(vectors, "TILE", 3, raising=False)
    df = table(spark)
    result = operator(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(result))
    assert got == brute(rows_of(df), ints)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_queries_meet_the_blocks_in_rounds(spark, monkeypatch):
    """A round a group of queries, each written before the next: shuffles would otherwise hold every block once a group."""
    made, kept = [], vectors.Kept

    def seen(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(vectors, "Kept", seen)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "ASKED", 20)
    df = table(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(neighbours.nearest(df)))
    assert got == brute(rows_of(df), False)
    rounds = [plan for name, plan in made if name == "nearest"]
    assert len(rounds) > 1 and not any("Broadcast" in plan or "Join" in plan for plan in rounds)
