"""Language-model scoring with sharded Elias-Fano n-gram tries.

Base: P1(w) = (c + 0.1) / (N + 0.1 (V + 1)) over the training tokens. The model of order n goes up from it:
    Pk(w | h) = (c(h, w) + t(h) Pk-1(w | shorter h)) / (c(h) + t(h)),  t(h) = PRIOR * c(h) ** POWER,
a Dirichlet prior whose weight grows with the context's count c(h) as the number of distinct followers does. It is one
rule for every context and every size of corpus, and adds up to 1 over the known words and one unknown word. The context is
the words before in the text; the text's start counts as one.

Texts are tokenised once into blocks (word numbers and a sorted word list). Words, then n-grams of each order, are dealt
to shards by hash as compact sorted lists, one row per block and shard, so a word or n-gram that many texts share costs
one entry a block, and the followers of a frequent context are spread over all shards. A word shard adds up counts and
numbers the words. An n-gram shard adds up counts, builds its trie of quantised probabilities c / N and looks up every
block's n-grams in it; what goes back is a 16-bit code an n-gram. All counts cover all training texts; shards grow in
number, not in size, with the corpus. Codes are 1/512 of a decade: counts below 220 come back exactly, larger ones to half
a per cent, a context's rounded up and an n-gram's down, so that probabilities never add up to more than 1.

N-grams are named by hashes whose width follows the number of tokens, some bits of the context and three times as many of
context and word: an n-gram shares its name with another with a probability of about 2 ** -NAME_BITS. The last bits of a
name are its shard, so they need not travel.

Defined cases: null texts are empty and have one token, the end; an empty table gives no rows. Without training texts N
and V are 0, and every token gets the probability 1 of the unknown word. Rows that repeat count and are scored each. A very
long text is a block of its own, in one task's memory. More than 2**32 - 8 distinct words raise an error. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Kept, balanced, expand, frame, gathered, is_train, rows, sized, slices, squeeze, table, unframe
from .elias_fano import NONE, STEP, Trie, decode

HELD = (10, 0)
ALPHA = 0.1
ORDER = 3
PRIOR, POWER = 1.0, 0.9
BLOCK_BYTES = 6 << 20
#: Words of all blocks, or distinct n-grams of all blocks at most, that a shard is meant to get.
SHARD_WORDS, SHARD_GRAMS = 400_000, 1_000_000
#: N-grams looked up at once, few enough for the CPU's cache.
LOOKUPS = 1 << 15
#: Word lists are ordered by this many hash buckets first; a power of two of shards divides them.
BUCKET_BITS = 24
NAME_BITS = 16
START, END, FIRST = 0, 1, 2
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "block long, n long, n_train long, n_words long, words binary, payload binary"
ROW = "block long, kind int, shard int, n long, payload binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def _bucket(words: pa.Array) -> np.ndarray:
    """A hash of each word, of BUCKET_BITS. No word is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_binary(words.type) else np.int64, len(words) + 1, words.offset * (4 if pa.types.is_binary(words.type) else 8)).astype(np.int64)
    values = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _P, np.uint64))
    h = np.add.reduceat((values + np.uint64(1)) * powers[np.arange(len(values)) - np.repeat(starts, lengths)], starts)
    return (_mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _blocks(batches):
    """Block rows: ids, tokens by text, whether learned from, word numbers and the words' buckets; and the words, ordered by bucket and bytes, with their counts."""
    block = TaskContext.get().partitionId() << 32
    for batch in gathered(batches, 1, BLOCK_BYTES):
        texts = batch.column(1).fill_null("")
        ids, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        for s, e in slices((pc.binary_length(texts).to_numpy() + 1).tolist(), BLOCK_BYTES):
            tokens = pa.ListArray.from_arrays(*_split(texts.slice(s, e - s)))
            n = np.diff(tokens.offsets.to_numpy())
            coded = tokens.values.dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy()
            order = np.lexsort((pc.rank(words, tiebreaker="first").to_numpy() if len(words) else np.zeros(0), _bucket(words)))
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            words = words.take(pa.array(order))
            learned = np.repeat(train[s:e], n)
            codes = place[codes] if len(codes) else np.zeros(0, "<u4")
            counts = np.bincount(codes[learned], minlength=len(words)).astype("<u4")
            payload = frame([_ids(ids.slice(s, e - s)), squeeze(n.astype("<u4")), np.packbits(train[s:e]).tobytes(), squeeze(codes), squeeze(np.diff(_bucket(words), prepend=0).astype("<u4"))])
            listed = frame([squeeze(np.frombuffer(b"\n".join(words.to_pylist()), np.uint8)), squeeze(counts)])
            yield rows(BLOCKS, {"block": [block], "n": [len(codes) + e - s], "n_train": [int(train[s:e].sum())], "n_words": [len(words)], "words": [listed], "payload": [payload]})
            block += 1


def _split(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Offsets and words (bytes) of the texts, A-Z in lower case."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends splits off empty words
    before = np.concatenate([[0], np.cumsum(full)])
    return pa.array(before[offsets].astype(np.int32)), words.filter(pa.array(full)).cast(pa.binary())


def _ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.record_batch([ids], names=["id"]))
    return sink.getvalue().to_pybytes()


class Corpus:
    """What the driver knows after the words are counted, and what follows from it. Small; goes to the executors with the code."""

    def __init__(self, order: int, n_train: int, tokens: int, per_shard: np.ndarray, n_words: int, n_tokens: int):
        self.order, self.n_train, self.n_words, self.n_tokens = order, n_train, n_words, n_tokens
        self.base = np.concatenate([[0], np.cumsum(per_shard)])
        self.word_shards = len(per_shard)
        self.unknown = int(self.base[-1]) + FIRST
        if self.unknown >= 1 << 32:
            raise ValueError("more distinct words than 32-bit word numbers")
        self.shards = 1 << max(0, math.ceil(math.log2(max(1, tokens / SHARD_GRAMS))))
        self.last = np.uint64(self.shards.bit_length() - 1)  # bits of a name that are its shard
        width = min(64, max(1, tokens).bit_length() + NAME_BITS)
        self.lead = width // 4  # bits of a name that are of the context alone; contexts may share them
        self.rest = width - self.lead  # bits that tell apart all that follows them


class Block:
    """A block row read back, with the words' numbers and counts from the answers of the word shards."""

    def __init__(self, payload: bytes, answers: dict[int, bytes], shards: int, base: np.ndarray):
        p = unframe(payload)
        self.ids = pa.ipc.open_stream(p[0]).read_all().column(0)
        self.n = expand(p[1], "<u4").astype(np.int64)
        self.train = np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(self.n)).astype(bool)
        self.codes = expand(p[3], "<u4")
        bucket = np.cumsum(expand(p[4], "<u4"), dtype=np.int64)
        cut = np.searchsorted(bucket * shards >> BUCKET_BITS, np.arange(shards + 1))
        self.number, self.total = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), np.int64)
        for k, b in answers.items():
            number, total = unframe(b)
            at, total = slice(cut[k], cut[k + 1]), expand(total, "<i8")
            self.number[at] = np.where(total > 0, np.cumsum(expand(number, "<u4"), dtype=np.int64) + base[k] + FIRST, -1)
            self.total[at] = total

    def chains(self, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token, ends included: number (`unknown` for unknown words), count, and place in its text."""
        ends = np.cumsum(self.n + 1) - 1
        m = len(self.codes) + len(self.n)
        own, count, word = np.full(m, END, np.uint64), np.full(m, corpus.n_train, np.int64), np.ones(m, bool)
        word[ends] = False
        own[word], count[word] = np.where(self.number < 0, corpus.unknown, self.number)[self.codes], self.total[self.codes]
        return own, count, np.arange(m) - np.repeat(ends - self.n, self.n + 1)


def _deal_words(shards: int):
    def run(batches):
        for batch in batches:
            for block, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, counts = unframe(listed)
                raw, counts = expand(raw, np.uint8).tobytes(), expand(counts, "<u4")
                words = pa.array(raw.split(b"\n") if raw else [], pa.binary())
                cut = np.searchsorted(_bucket(words) * shards >> BUCKET_BITS, np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[k], cut[k + 1]) for k in full]
                dealt = [frame([squeeze(np.frombuffer(b"\n".join(words[at].to_pylist()), np.uint8)), squeeze(counts[at])]) for at in parts]
                yield rows(ROW, {"block": [block] * len(full), "kind": [1] * len(full), "shard": full, "n": [0] * len(full), "payload": dealt})

    return run


def _add_words(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Answers of a word shard: number and count (0 if never learned) per word. One row of kind 2 has its totals."""
    parts = [unframe(b) for b in group.column("payload").to_pylist()]
    lists = [expand(p[0], np.uint8).tobytes().split(b"\n") for p in parts]
    counts = [expand(p[1], "<u4").astype(np.int64) for p in parts]
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    at = coded.indices.to_numpy()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    order = np.lexsort((pc.rank(coded.dictionary, tiebreaker="first").to_numpy(), _bucket(coded.dictionary)))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))  # the order of every block's list, so that its numbers rise
    ends = np.cumsum([len(x) for x in lists])
    answers = [frame([squeeze(np.diff(number[at[s:e]], prepend=0).astype("<u4")), squeeze(total[at[s:e]])]) for s, e in zip([0, *ends], ends)]
    shard = key[0].as_py()
    n = len(answers)
    return table(ROW, {"block": [*group.column("block").to_pylist(), -1], "kind": [1] * n + [2], "shard": [shard] * (n + 1), "n": [0] * n + [len(total)], "payload": [*answers, np.array([(total > 0).sum(), total.sum()], "<i8").tobytes()]})


def _read(group: pa.Table, corpus: Corpus) -> Block | None:
    """The block of a group of rows of kinds 0 and 1."""
    kind, shard, payload = (group.column(c).to_pylist() for c in ("kind", "shard", "payload"))
    own = [p for k, p in zip(kind, payload) if k == 0]
    return Block(own[0], {s: p for k, s, p in zip(kind, shard, payload) if k == 1}, corpus.word_shards, corpus.base) if own else None


class Grams:
    """The distinct n-grams of one order in a block that can have been learned, ordered by shard and name, and where each token's is among them (-1: it has none)."""

    def __init__(self, names: np.ndarray, has: np.ndarray, learned: np.ndarray, corpus: Corpus):
        shard = names & np.uint64(corpus.shards - 1)
        ordered = (names >> corpus.last) | (shard << (np.uint64(64) - corpus.last)) if corpus.shards > 1 else names  # a name's last bits come first
        found, at = np.unique(ordered[has], return_inverse=True)
        self.at = np.full(len(names), -1, np.int64)
        self.at[has] = at.ravel()
        self.cut = np.searchsorted(found >> (np.uint64(64) - corpus.last), np.arange(corpus.shards + 1)) if corpus.shards > 1 else np.array([0, len(found)])
        self.names = found & (np.uint64(0xFFFFFFFFFFFFFFFF) >> corpus.last)  # without the shard
        self.learned = np.bincount(self.at[has & learned], minlength=len(found)).astype("<u4")


def grams(block: Block, corpus: Corpus):
    """Of each order from 2 the Grams. A name's high bits are of the context, its low bits of the context and what follows it."""
    own, _, place = block.chains(corpus)
    learned = np.repeat(block.train, block.n + 1)
    known = own != np.uint64(corpus.unknown)
    before = np.concatenate([np.array([START], np.uint64), own[:-1]])
    before[place == 0] = START
    has, context = known & (before != np.uint64(corpus.unknown)), _mix(before)
    for order in range(2, corpus.order + 1):
        if order > 2:
            has = known & (place >= order - 2) & np.concatenate([[False], has[:-1]])
            context = np.concatenate([np.zeros(1, np.uint64), whole[:-1]])  # noqa: F821  the last round's n-gram is this round's context
        whole = _mix(context * _P + own)
        yield Grams(((context >> np.uint64(64 - corpus.lead)) << np.uint64(corpus.rest)) | (whole >> np.uint64(64 - corpus.rest)), has, learned, corpus)


def _deal_grams(corpus: Corpus):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        block = _read(group, corpus)
        out: dict = {"block": [], "kind": [], "shard": [], "n": [], "payload": []}
        for order, g in enumerate(grams(block, corpus), 2) if block else ():
            for k in np.flatnonzero(np.diff(g.cut)):
                at = slice(g.cut[k], g.cut[k + 1])
                payload = frame([squeeze(np.diff(g.names[at], prepend=np.uint64(0))), squeeze(g.learned[at])])
                for name, x in zip(out, (key[0].as_py(), order, int(k), 0, payload)):
                    out[name].append(x)
        return table(ROW, out)

    return run


def build(names: np.ndarray, c: np.ndarray, n_tokens: int, rest: int) -> Trie:
    """The trie of distinct sorted names with their counts; rest: low bits that name what follows the context."""
    return Trie(names >> np.uint64(rest), names & np.uint64((1 << rest) - 1), c / n_tokens)


def _look_up(corpus: Corpus):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order, shard = key[0].as_py(), key[1].as_py()
        rest = corpus.rest - int(corpus.last)
        asked = []
        for b in group.column("payload").to_pylist():
            d, c = unframe(b)
            asked.append((np.cumsum(expand(d, "<u8"), dtype=np.uint64), expand(c, "<u4")))
        every = np.concatenate([a[0] for a in asked])
        by = np.argsort(every, kind="stable")  # merges the sorted lists
        ranked = every[by]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        names, at = ranked[new], np.empty(len(by), np.int32)
        at[by] = np.cumsum(new) - 1
        del every, by, ranked, new
        c = np.bincount(at, np.concatenate([a[1] for a in asked]), minlength=len(names)).astype(np.int64)
        seen = c > 0
        trie = build(names[seen], c[seen], max(1, corpus.n_tokens), rest).mapped()
        low = np.uint64((1 << rest) - 1)
        codes = np.concatenate([trie.lookup(names[s : s + LOOKUPS] >> np.uint64(rest), names[s : s + LOOKUPS] & low) for s in range(0, len(names), LOOKUPS)])
        ends = np.cumsum([len(a[0]) for a in asked])
        out = [squeeze(codes[at[s:e]]) for s, e in zip([0, *ends], ends)]
        return table(ROW, {"block": group.column("block").to_pylist(), "kind": [order] * len(out), "shard": [shard] * len(out), "n": [0] * len(out), "payload": out})

    return run


def counts(codes: np.ndarray, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count that a code stands for; the same below 220."""
    near = decode(codes) * n_tokens
    low = np.ceil(near * (1 - 1e-9) - 1e-9)
    return low, np.where(codes == NONE, 0, np.maximum(low, np.floor(near * 10.0 ** (1 / STEP) * (1 + 1e-9) + 1e-9)))


def _score(corpus: Corpus, id_type: pa.DataType):
    names = ["id", "train", "n_tokens", "n_known", "base_score", "score"]
    floor = corpus.n_tokens + ALPHA * (corpus.n_words + 1)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table, answers: pa.Table) -> pa.Table:
        block = _read(group, corpus)
        if not block:
            return pa.table([pa.array([], t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        got = {(k, s): p for k, s, p in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "payload")))}
        _, count, place = block.chains(corpus)
        p = base = (count + ALPHA) / floor
        context = np.concatenate([[0], count[:-1]]).astype(float)
        context[place == 0] = corpus.n_train
        for order, g in enumerate(grams(block, corpus), 2):
            codes = np.full(len(g.names) + 1, NONE, "<u2")  # the last is of tokens without an n-gram
            for k in np.flatnonzero(np.diff(g.cut)):
                codes[g.cut[k] : g.cut[k + 1]] = expand(got[order, int(k)], "<u2")
            least, most = counts(codes[g.at], corpus.n_tokens)
            prior = PRIOR * context**POWER
            on = context > 0
            p = np.where(on, (np.minimum(least, context) + prior * p) / np.where(on, context + prior, 1), p)
            context = np.concatenate([[0], most[:-1]])
            context[place < order - 1] = 0  # the next order's context would reach beyond the text's start
        first = np.concatenate([[0], np.cumsum(block.n + 1)[:-1]])
        total = lambda x: np.add.reduceat(x, first)  # noqa: E731  every text has its end
        columns = [block.ids.combine_chunks(), pa.array(block.train), pa.array(block.n + 1), pa.array(total((count > 0).astype(np.int64)))]
        return pa.table([*columns, pa.array(total(np.log10(base))), pa.array(total(np.log10(p)))], names=names)

    return run


def score(df: DataFrame, train, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows where the column `train` holds."""
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = Kept(balanced(source).mapInArrow(_blocks, BLOCKS), "lm-blocks").df
    tokens, n_train, entries = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("n_train"), F.sum("n_words")).first())
    word_shards = 1 << min(BUCKET_BITS, max(0, math.ceil(math.log2(max(1, entries / SHARD_WORDS)))))
    dealt = blocks.select("block", "words").mapInArrow(_deal_words(word_shards), ROW)
    words = Kept(sized(dealt.groupBy("shard").applyInArrow(_add_words, ROW), entries, 1 << 22), "lm-words").df
    sums = {r["shard"]: (r["n"], *np.frombuffer(r["payload"], "<i8").tolist()) for r in words.where("kind = 2").collect()}  # a row a shard
    per = np.array([sums.get(k, (0, 0, 0))[0] for k in range(word_shards)], np.int64)
    corpus = Corpus(order, n_train, tokens, per, sum(x[1] for x in sums.values()) + (n_train > 0), sum(x[2] for x in sums.values()) + n_train)
    asked = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("shard"), "n", "payload").union(words.where("kind = 1"))
    found = asked.groupBy("block").applyInArrow(_deal_grams(corpus), ROW)
    codes = found.groupBy("kind", "shard").applyInArrow(_look_up(corpus), ROW)
    # the same exchange of the blocks is read for dealing and for scoring
    kind = source.schema["id"].dataType
    done = asked.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_score(corpus, to_arrow_type(kind)), f"id {kind.simpleString()}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id), "train", "n_tokens", "n_known", F.lit(corpus.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, is_train("doc_id", *HELD))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
