"""Exact top-k search by multi-resolution segment statistics.

Vectors become integers floor(SCALE * x). At each level a vector is cut into segments and kept as their means and
deviations. For segments of length n,
    |q - x|^2 >= sum n ((mean q - mean x)^2 + (dev q - dev x)^2),
and as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a lower bound of the distance is an upper bound of the score,
    q.x <= sum n (mean q mean x + dev q dev x).
Levels run from coarse to fine. At each the candidates nearest by their means are scored exactly, so that a query knows a
score that k candidates reach, and a pair whose bound falls short of it is out: it meets no finer level. Exact integer
products are computed for the survivors.

How many pairs fall out depends on the vectors; which way they are computed does not change the result: where more than
SPARSE of a tile's pairs are left, a level's bounds and the exact scores come as one matrix product, which then costs
less than products pair by pair.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, zero vectors do; a
query with fewer candidates than k gets them all; equal scores go to the smaller id; rows that repeat are candidates of
their own; an empty table gives no rows. A score that does not fit a long raises an error. Other columns, whatever their
names, take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import search

K = 20
MODULUS = 20
SCALE = 64
#: Segments by level, coarse to fine.
LEVELS = (4, 16, 32)
CELLS = 4 << 20
#: Share of a tile's pairs from which a matrix product costs less than products pair by pair.
SPARSE = 0.03
#: Candidates scored at each level for what a query can reach, in k.
PROBES = 4


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length: squared differences then add up to the bound."""
    parts = np.array_split(v, min(segments, v.shape[1]), axis=1)
    return np.stack([s * np.sqrt(p.shape[1]) for p in parts for s in (p.mean(axis=1), p.std(axis=1))], axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of paired rows."""
    if not len(q):
        return np.zeros(0, np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    return np.array([sum(int(a) * int(b) for a, b in zip(u, w)) for u, w in zip(q, x)], np.int64)


def bound(q: np.ndarray, x: np.ndarray, segments: int) -> np.ndarray:
    """Upper bounds of the scores of all pairs, by lower bounds of their squared distances."""
    return _bounds(statistics(q, segments), statistics(x, segments), q, x)[1]


def _bounds(a: np.ndarray, b: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the means alone say of all pairs' scores, and the upper bounds."""
    near = a[:, ::2] @ b[:, ::2].T
    return near, near + a[:, 1::2] @ b[:, 1::2].T + _slack(q)[:, None] + _slack(x)[None, :]


def _slack(v: np.ndarray) -> np.ndarray:
    """For rounding."""
    return 1e-9 * (v**2).sum(axis=1) + 1e-6


def prune(q: np.ndarray, x: np.ndarray, levels: list[np.ndarray], alive: np.ndarray, k: int):
    """Takes out of alive, level by level, the pairs that cannot be among a query's k best; yields the share that is left."""
    reached, probes = np.full(len(q), -np.inf), min(len(x), PROBES * k)
    for segments, b in zip(LEVELS, levels):
        a = statistics(q, segments)
        if alive.mean() > SPARSE:
            near, most = _bounds(a, b, q, x)
            near[~alive] = -np.inf
            first = np.argpartition(near, len(x) - probes, axis=1)[:, len(x) - probes :]
            score = exact(np.repeat(q, probes, axis=0), x[first.ravel()]).reshape(len(q), probes).astype(float)
            score[~np.take_along_axis(alive, first, axis=1)] = -np.inf
            reached = np.maximum(reached, np.partition(score, probes - k, axis=1)[:, probes - k])
            alive &= most >= reached[:, None]
        else:
            i, j = np.nonzero(alive)
            most = np.einsum("ij,ij->i", a[i], b[j]) + _slack(q)[i] + _slack(x)[j]
            alive[i, j] = most >= reached[i]
        yield alive.mean()


def tile(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, x = np.floor(SCALE * q), np.floor(SCALE * x)
    found = []
    levels = [statistics(x, n) for n in LEVELS]
    step = max(1, CELLS // max(1, len(x)))
    for s in range(0, len(q), step):
        part, here = q[s : s + step], own[s : s + step]
        alive = np.ones((len(part), len(x)), bool)
        mine = np.flatnonzero(here >= 0)
        alive[mine, here[mine]] = False
        if len(x) > k + 1:
            for _ in prune(part, x, levels, alive, k):
                pass
            if alive.mean() > SPARSE and np.abs(part).max() * np.abs(x).max() * part.shape[1] < 2.0**53:  # then exact in doubles
                score = np.where(alive, part @ x.T, -np.inf)
                alive &= score >= np.partition(score, len(x) - k, axis=1)[:, len(x) - k, None]
        a, b = np.nonzero(alive)
        found.append((a + s, b))
    a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    score = np.concatenate([exact(q[a[s : s + (1 << 18)]], x[b[s : s + (1 << 18)]]) for s in range(0, len(a), 1 << 18)]) if len(a) else np.zeros(0, np.int64)
    return a, b, score


def top(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, modulus: int = MODULUS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by modulus the k other rows of highest score."""
    return search(df, id, vector, k, modulus, True, "long", tile)


def query(spark, sf_dir: str) -> DataFrame:
    return top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
