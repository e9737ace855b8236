"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two link at TAU or fewer differing bits. The bits are grouped into m parts, correlated bits
together, and part i gets a threshold t_i >= -1 with sum(t_i) = TAU - m + 1: a linked pair then differs by at most t_i
bits in some part with t_i >= 0. Thresholds come from a dynamic program over estimated candidate counts, m from the
least total. Every fingerprint is listed under its own part's value and each lesser one within t_i of it, so that a pair
meets under the lesser of its two values; pairs that meet in a list are verified on all 64 bits. Equal fingerprints are
one class from the start. The plan of parts only decides the cost: it is fitted to a bounded sample and to a table of
DESIGN fingerprints whatever the table's size, so the rows listed stay in proportion to the table; the links are exact
whatever it is.

A long list is cut into chunks and each pair of chunks is a task of its own; a task hands on a spanning star of the
links it found, so a dense group costs as many rows as it has members.

The pipeline's stage asks for a Jaccard similarity of NEAR over runs of NEAR_WORDS words. Its fingerprints over such runs link
at NEAR_BITS or fewer differing bits by the same pigeonhole and components, and each component is a list of candidates. Many
pairs at NEAR differ by 8 to 10 bits, too many for the pigeonhole: bands of MinHash are further lists. The links are those
pairs of a list, of either kind, whose exact similarity is NEAR or more.

Defined cases: null or empty texts have fingerprint zero, which links like any other. Rows with a null id keep a row of
their own; their component is the smallest id that is not null, or null if there is none. Rows that repeat are rows of
their own; an empty table gives no rows; texts are whole, however long, each in one task's memory. Other columns, whatever
their names, take no part.
"""

from __future__ import annotations

import functools
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, balanced, expand, free, map_batches, own_columns, row_hash, rows, sized, squeeze, table, texts_of
from .components import local_stars, stars

TAU = 4
WORDS = 4
SEED = 42
#: The pipeline's stage: near copies share this much of their runs of NEAR_WORDS words.
NEAR, NEAR_WORDS = 0.8, 5
#: Bits at which the stage's fingerprints link.
NEAR_BITS = 5
#: MinHash bands and minima in each. A pair at NEAR shares no band with probability (1 - NEAR ** DEPTH) ** BANDS, 3e-6.
BANDS, DEPTH = 32, 5
#: Bits kept of a shingle's hash where sets are compared.
SET_BITS = 48
#: Members of a list that the others are held against first.
CENTRES = 2
#: Bound of the sample that the parts are fitted to.
SAMPLE = 20_000
#: A list longer than this is cut into chunks of this many.
CHUNK = 2_048
#: Listed rows that a task holds at once, besides one list or pair of chunks.
ROWS = 1 << 19
#: What a listed row costs, in candidate pairs.
ROW_COST = 12
#: Fingerprints of the table that the thresholds are fitted to, about 20 GB of texts. With the true number a larger table had more rows a fingerprint.
DESIGN = 1 << 23
#: Rows that a fingerprint is listed in at most, on average.
LISTED = 20


def shingles(text: str, width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's runs of `width` words, in order; a shorter text is one run, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[: -width + 1].tolist(), ends[width - 1 :].tolist())], "<u8")


def fingerprint(text: str, width: int = WORDS, seed: int = SEED) -> int:
    return majority(shingles(text, width, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield type(batch).from_arrays([batch.column(0), rows("fp long", {"fp": fp}).column(0)], names=["id", "fp"])

    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return balanced(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each takes, bit by bit, what correlates most with what it has."""
    x = bits - bits.mean(axis=0)
    scale = np.maximum(np.sqrt((x**2).sum(axis=0)), 1e-9)
    like = np.abs(x.T @ x) / np.outer(scale, scale)
    free, parts = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        part = [min(free, key=lambda b: (-like[b, list(free - {b})].sum(), b))] if len(free) > 1 else [min(free)]
        free -= set(part)
        while len(part) < width:
            best = min(free, key=lambda b: (-like[b, part].sum(), b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def _near(bits: np.ndarray, part: list[int], draw: np.random.Generator) -> np.ndarray:
    """Estimated share of pairs that differ by at most 0, 1, ... TAU bits in the part: seen among random pairs, or as if the bits were independent, whichever is more."""
    q = 2 * bits[:, part].mean(axis=0) * (1 - bits[:, part].mean(axis=0))
    p = np.zeros(TAU + 1)
    p[0] = 1
    for x in q:
        p = p * (1 - x) + np.concatenate([[0], p[:-1]]) * x
    a, b = draw.integers(0, len(bits), (2, 200_000))
    seen = np.bincount((bits[a][:, part] != bits[b][:, part])[a != b].sum(axis=1), minlength=65)[: TAU + 1] / max(1, (a != b).sum())
    return np.maximum(np.cumsum(p), np.cumsum(seen))


def plan(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, for n fingerprints: the least cost of plans with at most LISTED (or tau + 1) rows a fingerprint."""
    if not len(sample):
        return []
    bits, draw, best = _bits(sample).astype(np.float32), np.random.Generator(np.random.PCG64(1)), None
    for m in range(2, tau + 2):
        parts = group_bits(bits, m)
        cost = []  # by threshold: rows a fingerprint, cost
        for part in parts:
            near = _near(bits, part, draw)
            listed = [(1 + sum(comb(len(part), j) for j in range(t + 1))) / 2 for t in range(min(2, tau) + 1)]
            cost.append([(0.0, 0.0)] + [(r, n * r * ROW_COST + n * n / 2 * near[t]) for t, r in enumerate(listed)])
        total = tau - m + 1 + m  # thresholds raised by 1, so that each is 0 or more
        table: dict[tuple[int, float], tuple[float, list[int]]] = {(0, 0.0): (0.0, [])}
        for c in cost:
            nxt: dict[tuple[int, float], tuple[float, list[int]]] = {}
            for (used, wide), (sofar, picks) in table.items():
                for t, (r, x) in enumerate(c):
                    at = (used + t, wide + r)
                    if at[0] <= total and at[1] <= max(LISTED, tau + 1) and (at not in nxt or sofar + x < nxt[at][0]):
                        nxt[at] = (sofar + x, [*picks, t - 1])
            table = nxt
        for (used, _), (x, picks) in table.items():
            if used == total and (best is None or x < best[0]):
                best = (x, [(p, t) for p, t in zip(parts, picks) if t >= 0])
    return best[1]


def project(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _ball(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for j in range(t + 1) for c in combinations(range(width), j)], np.uint64)


def listed(fps: np.ndarray, parts: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: under a part's own value and the lesser ones within its threshold."""
    keys, of = [], []
    for k, (part, t) in enumerate(parts):
        own = project(fps, part)
        value = own[:, None] ^ _ball(len(part), t)[None, :]
        row, column = np.nonzero(value <= own[:, None])
        keys.append(value[row, column] | np.uint64(k << 56))
        of.append(fps[row])
    return np.concatenate(keys), np.concatenate(of)


def links_in(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, parts: list[tuple[list[int], int]], tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the verified links between rows of equal key. side: 0 all with all, 1 and 2 only with each other."""
    own = np.zeros(len(keys), bool)  # the row lies under its own value, not under a neighbour's
    kind = (keys >> np.uint64(56)).astype(int)
    for k, (part, _) in enumerate(parts):
        of = kind == k
        own[of] = project(fps[of], part) == (keys[of] & np.uint64((1 << 56) - 1))
    order = np.lexsort((~own, keys))
    keys, fps, own, side = keys[order], fps[order], own[order], side[order]
    end = np.searchsorted(keys, keys, side="right")
    at, d = np.flatnonzero(own), 1
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0
    while len(at := at[at + d < end[at]]):
        x, y = fps[at], fps[at + d]
        hit = (np.bitwise_count(x ^ y) <= tau) & (x != y) & ((side[at] == 0) | (side[at] != side[at + d]))
        if hit.any():
            a.append(x[hit])
            b.append(y[hit])
            if (held := held + int(hit.sum())) > 1 << 21:
                x, y = local_stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
        d += 1
    return local_stars(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def links(distinct: DataFrame, tau: int = TAU, chunk: int = CHUNK) -> DataFrame:
    """distinct(fp) to (a, b): links whose components are those of all pairs at tau or fewer differing bits."""
    n = distinct.count()
    place = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 20))
    sample = distinct.where(place < min(1.0, SAMPLE / max(n, 1)) * (1 << 20)).orderBy("fp").limit(2 * SAMPLE).toArrow()
    sample = sample if sample.num_rows else distinct.limit(SAMPLE).toArrow()
    parts = plan(sample.column("fp").to_numpy().astype(np.int64).view(np.uint64), DESIGN, tau)

    def enlist(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(fps), 4_096):
                keys, of = listed(fps[s : s + 4_096], parts)
                yield rows("key long, fp long", {"key": keys.view(np.int64), "fp": of.view(np.int64)})

    def verify(batches):
        for keys, fps, side in cut_at(batches, 1):
            yield from linked(*links_in(keys.view(np.uint64), fps.view(np.uint64), side, parts, tau))

    def linked(a: np.ndarray, b: np.ndarray):
        for s in range(0, len(a), 1 << 16):
            yield rows("a long, b long", {"a": a[s : s + (1 << 16)].view(np.int64), "b": b[s : s + (1 << 16)].view(np.int64)})

    lists = Kept(distinct.mapInArrow(enlist, "key long, fp long"), "lists").df
    long = Kept(lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).withColumn("k", F.ceil(F.col("n") / chunk).cast("int")), "long").df
    usual = lists.join(long, "key", "left_anti").select("key", "fp", F.lit(0).alias("side"))
    found = usual.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")
    if long.isEmpty():
        return found
    # each pair i <= j of a long list's chunks is a task's work; a row goes to the k pairs that its chunk is in
    chunked = lists.join(long, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = chunked.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"))

    def verify_pairs(batches):
        for keys, lo, hi, fps, side in cut_at(batches, 3):
            new = np.flatnonzero((np.diff(keys) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for s, e in zip([0, *new], [*new, len(keys)]):
                yield from linked(*links_in(keys[s:e].view(np.uint64), fps[s:e].view(np.uint64), side[s:e], parts, tau))

    return found.union(pair.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(verify_pairs, "a long, b long"))


def cut_at(batches, lead: int, most: int = ROWS):
    """Columns of sorted rows in parts of about `most` rows; rows that are equal in the first `lead` columns stay together."""
    held: list[np.ndarray] = []
    for batch in batches:
        got = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, got)] if held else got
        if len(held[0]) >= most:
            new = np.zeros(len(held[0]) - 1, bool)
            for c in held[:lead]:
                new |= c[1:] != c[:-1]
            if new.any():
                end = int(np.flatnonzero(new)[-1]) + 1
                yield [c[:end] for c in held]
                held = [c[end:] for c in held]
    if held and len(held[0]):
        yield held


def components(df: DataFrame, id: str = "doc_id", text: str = "text", tau: int = TAU, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of df: id, fp and component, the smallest id reachable over links (itself included)."""
    fps = Kept(fingerprints(df, id, text, width, seed), "fingerprints").df
    classes = Kept(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes").df
    tree = stars(links(classes.select("fp"), tau)).df
    rooted = classes.join(tree.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    member = Kept(rooted.join(least, "root").select("fp", "component"), "members").df
    return fps.join(member, "fp").select("id", "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@functools.cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7))
    return draw.integers(0, 1 << 64, BANDS * DEPTH, np.uint64), draw.integers(0, 1 << 64, BANDS * DEPTH, np.uint64) | np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """Of a set of shingles one key a band: a hash of the band's DEPTH minima. Sets of similarity s agree in a band with probability s ** DEPTH."""
    flip, times = _mixers()
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 256):  # few enough for the CPU's cache
        x = (found[k : k + 256, None] ^ flip) * times
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEPTH).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketches(at: int, names: list[str]):
    """Of every text the hash of its set of shingles, its fingerprint, and the keys of its bands."""

    def run(batch):
        marks, fps, keys = [], [], []
        for text in texts_of(batch.column(at)):
            every = shingles(text, NEAR_WORDS)
            found = np.unique(every)
            marks.append(int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), np.uint64).view(np.int64)))
            fps.append(int(np.array(majority(every), np.uint64).view(np.int64)))
            keys.append(bands(found) if len(found) else [])
        return dict(zip(names, (marks, fps, keys)))

    return run


def _sets(batches):
    """(mark, text) to (mark, set): the set's hashes, SET_BITS of each, sorted and compressed."""
    for batch in batches:
        found = [np.unique(shingles(t, NEAR_WORDS) >> np.uint64(64 - SET_BITS)) for t in texts_of(batch.column(1))]
        yield rows("mark long, set binary", {"mark": batch.column(0), "set": [squeeze(np.diff(x, prepend=np.uint64(0))) for x in found]})


def _verify(batches):
    for batch in batches:
        for s in range(0, batch.num_rows, 1_024):
            part = batch.slice(s, 1_024)
            sets = [[np.cumsum(expand(x.as_py(), "<u8"), dtype=np.uint64) for x in part.column(c)] for c in (2, 3)]
            hit = np.array([similarity(x, y) >= NEAR for x, y in zip(*sets)], bool)
            yield rows("a long, b long", {c: part.column(k).to_numpy()[hit] for k, c in enumerate("ab")})


def _compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Links between members (mark, root, side, set) of a list, or of two of its chunks, that join their components."""
    mark, root, side = (group.column(c).to_numpy() for c in ("mark", "root", "side"))
    sets = [np.cumsum(expand(x.as_py(), "<u8"), dtype=np.uint64) for x in group.column("set")]
    size = np.array([len(x) for x in sets])
    _, label = np.unique(root, return_inverse=True)
    a, b = [], []
    for d in range(1, len(mark)):
        if label.min() == label.max():
            break
        x = np.arange(len(mark) - d)
        y = x + d
        may = (label[x] != label[y]) & ((side[x] == 0) | (side[x] != side[y])) & (np.minimum(size[x], size[y]) >= NEAR * np.maximum(size[x], size[y]))
        for i, j in zip(x[may].tolist(), y[may].tolist()):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= NEAR:
                a.append(mark[i])
                b.append(mark[j])
                label[label == label[j]] = label[i]
    return table("a long, b long", {"a": a, "b": b})


def near_classes(sets: DataFrame, n: int, tau: int = NEAR_BITS) -> DataFrame:
    """sets(mark, fp) to (mark, key): sets of one key have fingerprints that are linked at tau or fewer bits, directly or over others."""
    fps = Kept(sized(sets.select("fp").distinct(), n, 1 << 16), "near-prints").df
    tree = stars(links(fps, tau)).df.toDF("fp", "root")
    return sets.join(tree, "fp", "left").select("mark", F.xxhash64(F.coalesce("root", "fp"), F.lit("class")).alias("key"))


def near_links(lists: DataFrame, sets: DataFrame, centres: int = CENTRES, chunk: int = CHUNK) -> DataFrame:
    """lists(key, mark): members of classes and bands that more than one has; sets(mark, set). Gives (a, b): links whose components are
    those of all verified pairs that share a list.

    First a list's members are held against a few of them: a fixed number of pairs a member. What is of several components
    after that is compared within one task a list, a long list in pairs of its chunks; such a task gives links, not pairs.
    """
    n, tree = lists.count(), None
    member = lists.select("key", "mark", F.col("mark").alias("root"))
    if centres:
        place = lambda k: F.min(F.struct(F.xxhash64("mark", F.lit(k)).alias("h"), "mark"))["mark"]
        middle = lists.groupBy("key").agg(F.array(*[place(k) for k in range(centres)]).alias("m"))
        pairs = lists.select("key", "mark").join(middle, "key").select("mark", F.explode("m").alias("m")).where("mark <> m")
        pairs = pairs.select(F.least("mark", "m").alias("a"), F.greatest("mark", "m").alias("b")).distinct()
        full = sized(pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb"), n, 1 << 16)
        found = Kept(full.mapInArrow(_verify, "a long, b long"), "near-links").df
        tree = stars(found, known=found.count()).df
        member, n = _mixed(lists, tree, n)
        if not n:
            return tree
    many = member.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"))
    chunked = member.join(many, "key").withColumn("i", F.pmod(F.xxhash64("mark"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("long")
    given = chunked.select("key", "mark", "root", side.alias("side"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).join(sets, "mark")
    rest = given.groupBy("key", "lo", "hi").applyInArrow(_compare, "a long, b long").distinct()
    rest = Kept(sized(rest, n, 1 << 16), "near-links").df
    return rest if tree is None else rest.union(tree)


def _mixed(lists: DataFrame, tree: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Members (key, mark, root) of the lists that hold several components, and how many there are."""
    member = lists.select("key", "mark").join(tree.toDF("mark", "root"), "mark", "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    found = Kept(sized(member.join(mixed, "key"), n, 1 << 18), "near-members").df
    return found, found.count()


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies (similarity of NEAR or more, directly or over others) one row: that of the smallest id,
    then of the least hash; a row with a null id stays if no other in its group has an id. Texts without words are copies of
    each other. No group is ever gathered: rows are compared by minima, which are taken before any shuffle, and the texts
    themselves are shuffled twice, once for the sets to verify and once to take out those that go."""
    names = free(docs, "near_one", "near_two", "near_mark", "near_bands")
    one, two, mark, keys = names
    own = docs.withColumns({one: row_hash(docs, 1), two: row_hash(docs, 2)})  # 128 bits name a row
    source = own.select(one, two, F.col(id).alias("id"), F.col(text).alias("text")).toDF("one", "two", "id", "text")
    sketched = map_batches(source, "mark long, fp long, bands array<long>", _sketches(3, ["mark", "fp", "bands"]))
    marked = Kept(sketched.drop("text"), "near-marks").df
    n = marked.count()
    sets = Kept(sized(marked.groupBy("mark").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("one", "two")).alias("row")), n, 1 << 16), "near-sets").df  # of equal sets one
    classes = near_classes(sets.where(F.size("bands") > 0), n)
    lists = sets.select("mark", F.explode("bands").alias("key")).union(classes)
    several = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    lists = Kept(sized(lists.join(several, "key"), n, 1 << 15), "near-lists").df
    asked = sets.join(lists.select("mark").distinct(), "mark", "left_semi").select("mark", "row.one", "row.two")
    hashed = source.select("one", "two", "text").join(asked, ["one", "two"]).select("mark", "text").mapInArrow(_sets, "mark long, set binary")
    verify = Kept(sized(hashed.groupBy("mark").agg(F.first("set").alias("set")), n, 1 << 16), "near-shingles").df  # a row that repeats comes once
    found = near_links(lists, verify)
    tree = stars(found, known=found.count()).df.toDF("mark", "root")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "one", "two")
    best = marked.groupBy("mark").agg(F.min(place).alias("best")).join(tree, "mark", "left")
    stays = best.groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("best").alias("best")).select("best.one", "best.two")
    goes = marked.select("one", "two").distinct().join(stays, ["one", "two"], "left_anti")
    left = own.join(Kept(sized(goes, n, 1 << 18), "near-goes").df.toDF(one, two), [one, two], "left_anti")
    if not marked.groupBy("one", "two").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([one, two])
    return left.select(*own_columns(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_copies(docs)
