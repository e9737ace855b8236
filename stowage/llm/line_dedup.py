"""Line dedup: a sharded minimal perfect hash over the distinct line hashes indexes fingerprint and count arrays.

Documents are read in blocks. A block lists its distinct line keys (128-bit hashes) with the number of its documents
that hold each. Keys are dealt to shards by hash, one compact row per block and shard, so a line that a third of all
documents share costs one entry a block. A shard builds its perfect hash with a 32-bit fingerprint and a count per key,
and every block's keys probe those arrays; what goes back is one bit a key. No line is ever a join key.

Defined cases: a null or empty text is one empty line; empty keys are never counted or dropped. Rows count as documents
of their own, also when they repeat. A document all of whose lines go keeps the empty text. An empty table gives no rows. A
text of more than BLOCK_BYTES is a block of its own, in one task's memory. Other columns pass through, whatever their names;
a result column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, balanced, expand, folded, frame, free, gathered, map_batches, own_columns, rows, slices, squeeze, table, texts_of, unframe
from .mph import PerfectHash

MIN_DOCS = 10
#: Distinct keys that a shard is meant to hold, and bytes of text that a block is meant to hold.
SHARD_KEYS = 250_000
BLOCK_BYTES = 8 << 20
BLANK = b" \t\n\v\f\r"


def keys_of(text: str) -> list[bytes]:
    """The keys of a text's lines, empty ones included."""
    return [line.strip(BLANK).lower() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), "<u8").reshape(-1, 2)


def _blocks(batches):
    """Rows (block, n_keys, payload): ids of the documents, the distinct keys with counts, and per document its distinct keys."""
    block = TaskContext.get().partitionId() << 32
    for batch in gathered(batches, 2, BLOCK_BYTES):
        texts = texts_of(batch.column(2))
        mark, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for s, e in slices([len(t) + 1 for t in texts], BLOCK_BYTES):
            per, n = [], []
            for t in texts[s:e]:
                own = {k for k in keys_of(t) if k}
                per.extend(own)
                n.append(len(own))
            h = _hashes(per)
            both, at, counts = np.unique(h, axis=0, return_inverse=True, return_counts=True) if len(h) else (h, np.zeros(0, int), np.zeros(0, int))
            payload = frame([squeeze(mark[s:e]), squeeze(size[s:e].astype("<i8")), squeeze(np.array(n, "<u4")), squeeze(at.ravel().astype("<u4")), both.astype("<u8").tobytes(), squeeze(counts.astype("<u4"))])
            yield rows("block long, n_keys long, payload binary", {"block": [block], "n_keys": [len(both)], "payload": [payload]})
            block += 1


def _deal(shards: int):
    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = unframe(payload)
                h, counts = np.frombuffer(parts[4], "<u8").reshape(-1, 2), expand(parts[5], "<u4")
                shard = (h[:, 1] % np.uint64(shards)).astype(int)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    at = order[cut[k] : cut[k + 1]]
                    yield rows("shard int, block long, payload binary", {"shard": [k], "block": [block], "payload": [frame([h[at].tobytes(), squeeze(counts[at])])]})

    return run


class Shard:
    """Perfect hash, fingerprints and counts of one shard's keys."""

    def __init__(self, h: np.ndarray, counts: np.ndarray, most: int):
        keys, at = np.unique(h[:, 0], return_inverse=True)
        total = np.bincount(at.ravel(), counts, minlength=len(keys)).astype(np.int64)
        self.hash = PerfectHash(keys)
        place = self.hash.find(keys)
        kind = np.min_scalar_type(most)
        self.prints, self.counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), kind)
        first = np.zeros(len(keys), np.int64)
        first[at.ravel()[::-1]] = np.arange(len(h))[::-1]
        self.prints[place] = (h[first, 1] >> np.uint64(32)).astype(np.uint32)
        self.counts[place] = np.minimum(total, most).astype(kind)

    def at_least(self, h: np.ndarray, n: int) -> np.ndarray:
        at = self.hash.find(h[:, 0])
        known = at >= 0
        known[known] = self.prints[at[known]] == (h[known, 1] >> np.uint64(32)).astype(np.uint32)
        out = np.zeros(len(h), bool)
        out[known] = self.counts[at[known]] >= n
        return out


def _probe(min_docs: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [unframe(b) for b in group.column("payload").to_pylist()]
        h = [np.frombuffer(p[0], "<u8").reshape(-1, 2) for p in parts]
        shard = Shard(np.concatenate(h), np.concatenate([expand(p[1], "<u4") for p in parts]), min_docs)
        bits = [np.packbits(shard.at_least(x, min_docs)).tobytes() for x in h]
        return table("block long, shard int, payload binary", {"block": group.column("block").to_pylist(), "shard": [key[0].as_py()] * len(bits), "payload": bits})

    return run


def _answer(shards: int):
    none = table("mark long, size long, drops array<long>", {"mark": [], "size": [], "drops": []})

    def run(key: tuple[pa.Scalar, ...], block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return none
        p = unframe(block.column("payload")[0].as_py())
        mark, size, n, at = expand(p[0], "<i8"), expand(p[1], "<i8"), expand(p[2], "<u4"), expand(p[3], "<u4")
        h = np.frombuffer(p[4], "<u8").reshape(-1, 2)
        shard = (h[:, 1] % np.uint64(shards)).astype(int)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        common = np.zeros(len(h), bool)
        for k, b in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()):
            own = order[cut[k] : cut[k + 1]]
            common[own] = np.unpackbits(np.frombuffer(b, np.uint8), count=len(own)).astype(bool)
        doc = np.repeat(np.arange(len(mark)), n)
        hit = common[at]
        doc, keys = doc[hit], h[at[hit], 0].view(np.int64)
        which, start = np.unique(doc, return_index=True)
        drops = [keys[s:e].tolist() for s, e in zip(start, [*start[1:], len(keys)])]
        return table("mark long, size long, drops array<long>", {"mark": mark[which], "size": size[which], "drops": drops})

    return run


def common_lines(df: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, into: str = "drops") -> DataFrame:
    """df with one more column `into`: hashes of the document's lines that at least min_docs documents hold; null if there are none."""
    a, b = free(df, "line_mark", "line_size")
    marked = df.withColumn(a, F.xxhash64(F.col(id), F.col(text))).withColumn(b, F.coalesce(F.length(text), F.lit(-1)).cast("long"))
    blocks = Kept(balanced(marked.select(a, b, text)).mapInArrow(_blocks, "block long, n_keys long, payload binary"), "line-blocks").df
    shards = max(8, math.ceil((blocks.agg(F.sum("n_keys")).first()[0] or 0) / SHARD_KEYS))
    dealt = blocks.select("block", "payload").mapInArrow(_deal(shards), "shard int, block long, payload binary")
    answers = dealt.groupBy("shard").applyInArrow(_probe(min_docs), "block long, shard int, payload binary")
    drops = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer(shards), "mark long, size long, drops array<long>")
    once = Kept(drops.groupBy("mark", "size").agg(F.first("drops").alias("drops")), "line-drops").df
    return marked.join(once.hint("shuffle_hash").withColumnsRenamed({"mark": a, "size": b, "drops": into}), [a, b], "left").drop(a, b)


def without(text: str, drops: list[int] | None) -> tuple[int, int, str]:
    """Number of lines, of dropped lines, and the kept lines joined."""
    lines = text.split("\n")
    if not drops:
        return len(lines), 0, text
    gone, keys = set(drops), keys_of(text)
    hashes = _hashes(keys)[:, 0].view(np.int64).tolist()
    kept = [line for line, key, h in zip(lines, keys, hashes) if not key or h not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, into: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """df with the kept text, the number of lines and of dropped lines."""
    (own,) = free(df, "line_drops")
    found = common_lines(df, id, text, min_docs, own)
    at, drops = found.columns.index(text), found.columns.index(own)

    def run(batch):
        got = [without(t, d) for t, d in zip(texts_of(batch.column(at)), batch.column(drops).to_pylist())]
        return {into[0]: [g[2] for g in got], into[1]: [g[0] for g in got], into[2]: [g[1] for g in got]}

    return map_batches(found, f"{into[0]} string, {into[1]} long, {into[2]} long", run).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = common_lines(docs)

    def run(batch):
        got = [without(t, d) for t, d in zip(texts_of(batch.column(1)), batch.column(2).to_pylist())]
        return {"n_lines": [g[0] for g in got], "n_dropped": [g[1] for g in got], "kept_sha256": [hashlib.sha256(g[2].encode("utf-8", "surrogatepass")).hexdigest() for g in got]}

    return map_batches(found.select("doc_id", "text", "drops"), "n_lines long, n_dropped long, kept_sha256 string", run).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten or more documents go; text and n_chars follow."""
    kept, _, gone = names = free(docs, "kept_text", "n_lines", "n_dropped")
    found = dedup(docs, into=tuple(names))
    changed, same = F.col(gone) > 0, folded(docs)
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in map(same, docs.columns):
        new["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*own_columns(docs))
