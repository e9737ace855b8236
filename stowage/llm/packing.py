"""Best-fit packing of tokenised documents into sequences of at most SEQ tokens.

The number of pieces of each length (at most SEQ numbers, whatever the corpus) goes to the driver. There the
configuration linear program - how often to use each pattern of lengths that fits a sequence, so that every piece is
covered - is solved by multiplicative weights. A length's weight falls with the share of it that is covered; a knapsack
dynamic program prices the best pattern under those weights, and, from the same table, the best pattern with any given
length. A round takes steps, none beyond what is left to cover, along patterns within SLACK of the best whose lengths lag
most. The weights also are a dual solution, whose value bounds the program from below; the gap is logged.

Of the solution the patterns without waste are rounded down (shares of 1, 0.95 and 0.9 of it are tried), best fit
decreasing packs what they leave, and the rounding with the fewest sequences is kept. The plan is a table of runs: pieces
of a length, numbered by rank, go to sequences and offsets by arithmetic; only the ranks are computed over the pieces.

Defined cases: a null or empty text gives one piece, the end token; an empty table gives none. Rows are documents of their
own, also when they repeat or their id is null. Texts are encoded whole, however long, each by one task.
"""

from __future__ import annotations

import functools
import logging
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, arrow_schema, balanced, map_batches, texts_of

SEQ = 1024
END = 2
#: How much faster a weight falls than the covered share grows, the share of a length that one round covers at most, and
#: how far below the best pattern's value a round goes.
RATE, STEP, SLACK = 3.0, 0.1, 0.002
PIECES = "piece int, start long, length long, ids_crc32 long"


log = logging.getLogger("stowage")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str):
    """encode(text) to ids, as tokenizers gives them for the file. Where the same vocabulary lies beside it as ranks, tiktoken encodes (several times as fast) all but texts with a special token."""
    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda text: whole().encode(text, add_special_tokens=False).ids
    ranks = Path(path).with_suffix(".tiktoken")
    if Path(path).name != "byte_bpe_50k.json" or not ranks.exists():
        return slow
    import base64
    import json

    import public_tokenizers
    import tiktoken

    special = [t["content"] for t in json.loads(Path(path).read_bytes())["added_tokens"]]
    with ranks.open("rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def cut(n: int, seq: int = SEQ) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have seq ids."""
    first = n % seq or seq if n else 0
    return [(0, first), *((s, seq) for s in range(first, n, seq))]


def pieces(df: DataFrame, tokenizer: str, text: str = "text", seq: int = SEQ, end: int = END) -> DataFrame:
    """One row per piece: the columns of df but the text, and piece, start, length, ids_crc32."""
    at = df.columns.index(text)
    rest = [c for c in df.columns if c != text]
    added = arrow_schema(PIECES)

    def run(batches):
        import pyarrow as pa

        encode = encoder(tokenizer)
        for batch in batches:
            row, made = [], []
            for i, t in enumerate(texts_of(batch.column(at))):
                ids = np.array(encode(t) + [end], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), seq)):
                    row.append(i)
                    made.append((k, s, n, zlib.crc32(ids[s : s + n])))
            take = pa.array(row, pa.int64())
            columns = [batch.column(batch.schema.names.index(c)).take(take) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, f.type) for x, f in zip(zip(*made) if made else [[]] * 4, added))], names=[*rest, *added.names])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return balanced(df).mapInArrow(run, f"{schema}, {PIECES}" if rest else PIECES)


def price(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack. value: by length from 0, -inf where there is none. Gives the greatest value of each capacity and the length that it takes there (0: none)."""
    seq = len(value) - 1
    best, pick = np.zeros(seq + 1), np.zeros(seq + 1, np.int64)
    back = np.zeros(seq + 1)  # best from right to left
    for c in range(1, seq + 1):
        total = back[seq - c + 1 :] + value[1 : c + 1]
        k = int(total.argmax())
        best[c], pick[c] = (total[k], k + 1) if total[k] > best[c - 1] else (best[c - 1], 0)
        back[seq - c] = best[c]
    return best, pick


def pattern(pick: np.ndarray, capacity: int) -> dict[int, int]:
    """The lengths of the best pattern of a capacity."""
    out: dict[int, int] = {}
    while capacity > 0:
        n = int(pick[capacity])
        if n:
            out[n] = out.get(n, 0) + 1
        capacity -= n or 1
    return out


def solve(counts: dict[int, int], seq: int = SEQ, rate: float = RATE, step: float = STEP, slack: float = SLACK) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Patterns, as ((length, copies), ...), and how often to use them, which cover each length exactly; and a lower bound of all solutions.

    Steps are whole sequences as long as there are any. Where no pattern near the best can be used any more, the slack
    doubles; at last steps of less than a sequence cover the rest.
    """
    n = np.zeros(seq + 1)
    n[list(counts)] = list(counts.values())
    need, size, used, bound, whole = n.copy(), np.arange(seq + 1.0), {}, 0.0, True
    while (need > 1e-9).any():
        left = need > 1e-9
        weight = size * np.exp(rate * (np.divide(need, n, out=np.zeros(seq + 1), where=n > 0) - 1))
        value = np.where(left, weight, -np.inf)
        best, pick = price(value)
        if left.sum() == len(counts):
            bound = max(bound, float((n * weight).sum() / best[seq]))
        allowed = np.minimum(need, step * n + 8)
        moved = False
        for k in sorted(np.flatnonzero(left).tolist(), key=lambda k: (-need[k] / n[k], -k)):
            if allowed[k] < (1 if whole else 1e-9) or value[k] + best[seq - k] < (1 - slack) * best[seq]:
                continue
            found = pattern(pick, seq - k)
            found[k] = found.get(k, 0) + 1
            times = min(allowed[x] / c for x, c in found.items())
            times = float(int(times)) if times >= 1 else 0.0 if whole else times
            if times > 1e-9:
                for x, c in found.items():
                    allowed[x] -= times * c
                    need[x] -= times * c
                key = tuple(sorted(found.items()))
                used[key] = used.get(key, 0.0) + times
                moved = True
        if not moved:
            whole, slack = whole and slack < 1, slack * 2 if slack < 1 else 1.0
    return used, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, seq: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing over counts: [(pattern as (length index, copies), ...), sequences]; equal sequences are one entry."""
    open_: dict[int, list[list]] = {}
    done = []
    for k in range(len(lengths) - 1, -1, -1):
        n, size = int(counts[k]), int(lengths[k])
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                many = seq // size
                full, rest = divmod(n, many)
                for copies, bins in ((many, full), (rest, 1 if rest else 0)):
                    if bins:
                        left = seq - copies * size
                        (open_.setdefault(left, []) if left else done).append([((k, copies),), bins])
                break
            group = open_[room].pop()
            if not open_[room]:
                del open_[room]
            copies = min(room // size, n)
            bins = min(group[1], n // copies)
            if bins < group[1]:
                open_.setdefault(room, []).append([group[0], group[1] - bins])
            left = room - copies * size
            (open_.setdefault(left, []) if left else done).append([(*group[0], (k, copies)), bins])
            n -= copies * bins
    return [(p, n) for p, n in [*done, *(g for groups in open_.values() for g in groups)]]


def plan(counts: dict[int, int], seq: int = SEQ) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern of (length, copies), sequences)] that holds exactly counts[length] pieces of each length; those of the linear program first."""
    if not counts:
        return []
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths], np.int64)
    place = {int(x): k for k, x in enumerate(lengths)}
    used, bound = solve(counts, seq)
    full = sorted((p for p in used if sum(x * c for x, c in p) == seq), key=lambda p: (-used[p], p))
    best: list = []
    for share in (1.0, 0.95, 0.9):  # the less is rounded down, the more freedom is left to what packs the rest
        rest, chosen = n.copy(), []
        for p in full:
            at, c = np.array([place[x] for x, _ in p]), np.array([c for _, c in p])
            times = min(int(used[p] * share + 1e-6), int((rest[at] // c).min()))
            if times > 0:
                rest[at] -= times * c
                chosen.append((p, times))
        of_program = sum(t for _, t in chosen)
        left = np.flatnonzero(rest)
        chosen += [(tuple((int(lengths[left[k]]), c) for k, c in p), t) for p, t in best_fit(lengths[left], rest[left], seq)]
        if not best or sum(t for _, t in chosen) < sum(t for _, t in best):
            best, kept = chosen, of_program
    total = sum(t for _, t in best)
    log.info("packing: linear program %.1f, bound %.1f, gap %.3f %%, %d sequences, %d of them from the program", sum(used.values()), bound, 100 * (sum(used.values()) / bound - 1), total, kept)
    return best


def runs(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length an array of rows (first rank, copies, first sequence, offset), by rising rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            out.setdefault(length, []).append((ranks.get(length, 0), copies, first, offset))
            ranks[length] = ranks.get(length, 0) + copies * times
            offset += length * copies
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def place(cuts: DataFrame, seq: int = SEQ, per_bucket: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces (a table that can be read twice)."""
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq rows at most
    table = cuts.sparkSession.sparkContext.broadcast(runs(plan(counts, seq)))  # bounded by patterns and lengths, not by rows
    buckets = min(1024, max(16, sum(counts.values()) // per_bucket))
    keys = [c for c in cuts.columns if c not in ("length", "ids_crc32")]
    dealt = cuts.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sums.select("length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    # at most seq * 1024 rows of three numbers, so the broadcast is bounded
    ranked = dealt.withColumn("_row", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*keys)) - 1).join(F.broadcast(before), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row")
    at, rank = ranked.columns.index("length"), ranked.columns.index("_rank")

    def run(batch):
        length, r = batch.column(at).to_numpy(), batch.column(rank).to_numpy()
        sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for x in np.unique(length):
            of, t = length == x, table.value[int(x)]
            row = t[np.searchsorted(t[:, 0], r[of], side="right") - 1]
            k = r[of] - row[:, 0]
            sequence[of], offset[of] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * x
        return {"sequence_id": sequence, "offset": offset}

    return map_batches(ranked, "sequence_id long, offset long", run).drop("_rank")


def pack(df: DataFrame, tokenizer: str | None = None, id: str = "doc_id", text: str = "text", seq: int = SEQ) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for all rows of df."""
    cuts = Kept(pieces(df.select(id, text), tokenizer or vocabulary(), text, seq), "pieces").df
    return place(cuts, seq).select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
