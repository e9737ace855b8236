"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, float recomputation, heaps.

Each vector is scaled to int8 with its own step. For a tile the integer products of all its pairs come from one matrix
product, exactly. With q = q' + e and x = x' + f (quantised part and rest) the product differs from q'x' by at most
|e||x| + |q'||f|, so a pair whose upper bound is below the k-th greatest lower bound of its query cannot be among the k
best. The others are recomputed in double precision from the original vectors, so the search is exact (recall 1).

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; a query with
fewer candidates than k gets them all; equal scores go to the smaller id; rows that repeat are candidates of their own; an
empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import search

K = 20
MODULUS = 20
#: Cells of a tile that are held at once.
CELLS = 4 << 20


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    step[step == 0] = 1
    return np.rint(x / step).astype(np.int8), step


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the same order for every pair."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def tile(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q8, q_step = quantise(q)
    x8, x_step = quantise(x)
    q_near, x_near = q8 * q_step, x8 * x_step
    norm = lambda v: np.sqrt((v**2).sum(axis=1))
    q_off, q_size, x_off, x_size = norm(q - q_near), norm(q_near), norm(x - x_near), norm(x)
    exact = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64  # sums of int8 products that the type holds exactly
    right, found = x8.astype(exact).T, []
    for s in range(0, len(q), max(1, CELLS // max(1, len(x)))):
        e = min(len(q), s + max(1, CELLS // max(1, len(x))))
        near = (q8[s:e].astype(exact) @ right) * (q_step[s:e] * x_step.T)
        error = (q_off[s:e, None] * x_size[None, :] + q_size[s:e, None] * x_off[None, :]) * (1 + 1e-9) + 1e-12 * (q_size[s:e, None] + q_off[s:e, None]) * x_size[None, :]
        here = np.flatnonzero(own[s:e] >= 0)
        near[here, own[s:e][here]] = -np.inf
        if len(x) > k:
            least = np.partition(near - error, len(x) - k, axis=1)[:, len(x) - k, None]
            a, b = np.nonzero((near + error >= least) & np.isfinite(near))
        else:
            a, b = np.nonzero(np.isfinite(near))
        found.append((a + s, b))
    a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    score = np.concatenate([dots(q[a[s : s + (1 << 18)]], x[b[s : s + (1 << 18)]]) for s in range(0, len(a), 1 << 18)]) if len(a) else np.zeros(0)
    return a, b, score


def nearest(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, modulus: int = MODULUS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by modulus the k other rows of largest inner product."""
    return search(df, id, vector, k, modulus, False, "double", tile)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
