"""Blocked search of a stated query set against all rows: what the two vector searches share.

Vectors go into blocks of about BLOCK rows, one packed row a block, dealt evenly whatever their ids. The stated queries
of ASKED blocks and a chunk of at most CHUNK blocks meet in one cell, a group of one task: queries travel once a chunk and
blocks once a group of queries. A cell is a co-group and no join, so that no plan sends queries or vectors through the
driver. Each group of queries is a round of its own, whose lists are merged and written before the next starts and whose
shuffles are then given up: the disk holds the vectors twice and one round's lists, however many rounds there are. A tile
hands back at most k candidates a query; a cell merges its tiles' lists with heaps, and lists of cells are merged in further
steps, so no task gathers more than a block's queries times k for a bounded number of lists.
A tile's two sides are known by block and place, so a query's own row is excluded even where ids repeat. Vectors only
meet vectors of the same length. Rows with a null id take no part.
"""

from __future__ import annotations

import gc
import heapq
import math
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, frame, rows, table, unframe

BLOCK = 8_192
#: Blocks whose queries are in one cell, and those of them whose queries are in one tile.
ASKED, TILE = 128, 16
#: Candidate blocks of a cell at most; smaller tables have about CELLS chunks, so that all cores work.
CHUNK, CELLS = 16, 24
#: Lists that one merge takes at most.
FAN = 64


def usable(column: pa.Array, zero: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and vectors (double) that are not null or empty, hold no null or non-finite component and, if zero is false, are not zero."""
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy()) if not column.null_count else np.array([0 if v is None else len(v) for v in column.to_pylist()])
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)
    ends = np.cumsum(lengths)
    vectors = [values[e - n : e] for n, e in zip(lengths, ends)]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    keep = [i for i, v in enumerate(vectors) if valid[i] and len(v) and np.isfinite(v).all() and (zero or v.any())]
    return np.array(keep, np.int64), [vectors[i] for i in keep]


def _blocks(zero: bool, kind: str):
    def run(batches):
        from pyspark import TaskContext

        block, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keep, vectors = usable(batch.column(1), zero)
            for i, v in zip(ids[keep], vectors):
                found.setdefault(len(v), ([], []))
                found[len(v)][0].append(i)
                found[len(v)][1].append(v)
        for dim, (ids, vectors) in found.items():
            ids, x = np.array(ids, "<i8"), np.array(vectors, kind).reshape(len(ids), dim)
            yield rows("block long, dim int, payload binary", {"block": [block], "dim": [dim], "payload": [frame([ids.tobytes(), x.tobytes()])]})

    return run


def unpack(payload: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids, x = unframe(payload)
    return np.frombuffer(ids, "<i8"), np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)


def merge(lists: list[bytes], k: int) -> bytes:
    """Best k a query of several lists. A list: counts by query, then ids, scores and tie keys, each query's best first."""
    parts = []
    for b in lists:
        n, ids, score, tie, kind = unframe(b)
        n, ids, score, tie = np.frombuffer(n, "<i4"), np.frombuffer(ids, "<i8"), np.frombuffer(score, kind.decode()), np.frombuffer(tie, "<i8")
        ends = np.cumsum(n)
        parts.append((ends - n, ends, ids.tolist(), score.tolist(), tie.tolist()))
    n, out = [], []
    for i in range(len(parts[0][0])):
        runs = [zip([-x for x in s[a[i] : e[i]]], d[a[i] : e[i]], t[a[i] : e[i]]) for a, e, d, s, t in parts]
        best = list(islice(heapq.merge(*runs), k))
        n.append(len(best))
        out += best
    return listed(np.array(n), np.array([x[1] for x in out], "<i8"), np.array([-x[0] for x in out], kind.decode()), np.array([x[2] for x in out], "<i8"))


def listed(n: np.ndarray, ids: np.ndarray, score: np.ndarray, tie: np.ndarray) -> bytes:
    return frame([n.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), score.tobytes(), tie.astype("<i8").tobytes(), score.dtype.str.encode()])


def best_pairs(q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, c_block: int, m: int, k: int) -> bytes:
    """The list of a tile's scored pairs (query place q, candidate place c)."""
    tie = (c_block << 32) + c
    order = np.lexsort((tie, ids[c], -score, q))
    q, c, score, tie = q[order], c[order], score[order], tie[order]
    n = np.bincount(q, minlength=m)
    place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < k
    return listed(np.minimum(n, k), ids[c[keep]], score[keep], tie[keep])


def search(df: DataFrame, id: str, vector: str, k: int, modulus: int, zero: bool, score_type: str, tile: Callable) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by modulus the k best other rows.

    tile(q, x, own, k) gets the queries' and candidates' vectors and, per query, its own place among the candidates (-1
    if elsewhere); it gives (query places, candidate places, scores) that hold every query's k best of the tile.
    """
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    source = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>" if kind == "<f8" else "array<float>").alias("v")).where("id is not null and v is not null")
    count = max(2, math.ceil(source.count() / BLOCK))
    blocks = Kept(source.repartition(count).mapInArrow(_blocks(zero, kind), "block long, dim int, payload binary"), "vectors").df
    asked_blocks, tile_blocks, chunk = ASKED, TILE, min(CHUNK, math.ceil(count / CELLS))
    groups, chunks = math.ceil(count / asked_blocks), math.ceil(count / chunk)

    def queries(batches):
        for batch in batches:
            for block, dim, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids, x = unframe(payload)
                at = np.flatnonzero(np.frombuffer(ids, "<i8") % modulus == 0)
                if len(at):
                    own = np.frombuffer(x, kind).reshape(-1, dim)[at]
                    yield rows("q long, dim int, queries binary", {"q": [block], "dim": [dim], "queries": [frame([at.astype("<i8").tobytes(), np.frombuffer(ids, "<i8")[at].tobytes(), own.tobytes()])]})

    places = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    every = Kept(blocks.mapInArrow(queries, "q long, dim int, queries binary"), "queries").df if groups > 1 else blocks.mapInArrow(queries, "q long, dim int, queries binary")
    given = blocks.withColumn("c", F.floor(F.col("block") / chunk))
    listing = "q long, dim int, c long, ids binary, payload binary"

    def cell(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        dim, c, out = key[0].as_py(), key[1].as_py(), []
        for s in range(0, left.num_rows if right.num_rows else 0, tile_blocks):
            part = left.slice(s, tile_blocks)
            of = part.column("q").to_pylist()
            at, ids, q = zip(*(unframe(x.as_py()) for x in part.column("queries")))
            at, q = [np.frombuffer(x, "<i8") for x in at], np.concatenate([np.frombuffer(x, kind) for x in q]).reshape(-1, dim).astype(np.float64)
            ends = np.cumsum([len(x) for x in at])
            lists: list[list[bytes]] = [[] for _ in of]
            for block, payload in zip(right.column("block").to_pylist(), right.column("payload")):
                named, x = unpack(payload.as_py(), dim, kind)
                own = np.concatenate([y if n == block else np.full(len(y), -1) for n, y in zip(of, at)])
                a, b, score = tile(q, x, own, k)
                order = np.argsort(a, kind="stable")
                a, b, score = a[order], b[order], score[order]
                for i, (n, e) in enumerate(zip((len(y) for y in at), ends.tolist())):
                    lo, hi = np.searchsorted(a, [e - n, e])
                    lists[i].append(best_pairs(a[lo:hi] - (e - n), b[lo:hi], score[lo:hi], named, block, n, k))
            out += [(n, x, y[0] if len(y) == 1 else merge(y, k)) for n, x, y in zip(of, ids, lists)]
        return table(listing, {"q": [x[0] for x in out], "dim": [dim] * len(out), "c": [c // FAN] * len(out), "ids": [x[1] for x in out], "payload": [x[2] for x in out]})

    def merged(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return table(listing, {"q": [key[0].as_py()], "dim": [key[1].as_py()], "c": [key[2].as_py() // FAN], "ids": [group.column("ids")[0].as_py()], "payload": [merge(group.column("payload").to_pylist(), k)]})

    result = f"query_id long, rank int, vec_id long, score {score_type}"

    def final(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].as_py()
                n, found, score, _, kind_ = unframe(batch.column(1)[i].as_py())
                n = np.frombuffer(n, "<i4")
                first = np.cumsum(n) - n
                yield rows(result, {"query_id": np.repeat(np.frombuffer(ids, "<i8"), n), "rank": (np.arange(n.sum()) - np.repeat(first, n) + 1).astype(np.int32), "vec_id": np.frombuffer(found, "<i8"), "score": np.frombuffer(score, kind_.decode())})

    def round_of(g: int) -> DataFrame:
        asked = every.where((F.col("q") >= g * asked_blocks) & (F.col("q") < (g + 1) * asked_blocks)).withColumn("c", places(chunks))
        # a cell is long work, so cells are dealt to several times as many partitions: few meet in one task
        left, right = (x.repartition(min(1 << 12, 4 * chunks), "dim", "c") for x in (asked, given))
        lists = left.groupBy("dim", "c").cogroup(right.groupBy("dim", "c")).applyInArrow(cell, listing)
        for _ in range(max(1, math.ceil(math.log(chunks, FAN)))):
            lists = lists.groupBy("q", "dim", "c").applyInArrow(merged, listing)
        return lists.select("ids", "payload").mapInArrow(final, result)

    if groups == 1:
        return round_of(0)
    found = []
    for g in range(groups):
        found.append(Kept(round_of(g), "nearest").path)
        gc.collect()  # so that Spark's cleaner deletes the round's shuffles, which nothing refers to any more
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(result).parquet(*found)
