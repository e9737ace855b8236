"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A batch's distinct chunks (a run of spaces and what follows up to the next space; no piece crosses such a place) are
joined into one text and indexed by a suffix array, sorted as deep as the longest piece. Every piece is binary-searched
for its range of suffixes, which gives all its occurrences as edges. Edges are sorted by their end and relaxed from the
left: in a BPE encoding every beginning of a chunk is encoded by a beginning of the tokens, and a token may follow
another exactly if the two alone encode to themselves. So of the edges that end at a place just one is compatible with
the token that ends where it starts. Compatibility is worked out once per pair of tokens. All chunks relax together.
A character that no piece covers becomes a token of its own and is written as its bytes.

Defined cases: a null text is encoded like an empty one, to no pieces. The model's file is a parameter and must have
identity normalisation; other models raise an error. Rows that repeat are rows of their own; an empty table gives no rows. A
text of more than BLOCK_BYTES is worked on alone, in one task's memory. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced, gathered, rows, slices

SPACE = "▁"
BLOCK_BYTES = 8 << 20
#: Ids of characters that are no pieces: this plus the code point.
LOOSE = 1 << 24
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Cells of the table of known pairs.
CELLS = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        self.names = [own.id_to_piece(i) for i in range(size)]
        special = [own.is_control(i) or own.is_unknown(i) or own.is_unused(i) or own.is_byte(i) for i in range(size)]
        if own.normalize("aÅﬁ  b ") != f"{SPACE}aÅﬁ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model normalises texts or adds no space before them")
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(size) if own.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback")
        self.ids = {self.names[i]: i for i in range(size) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after other characters")
        self.rank = {p: (-own.get_score(i), i) for p, i in self.ids.items()}
        # pieces that merging never makes out of their own characters are no edges
        self.pieces = sorted(p for p in self.ids if self.merge(p) == [p])
        self.depth = max(map(len, self.pieces), default=1)
        self.piece_ids, self.piece_sizes = np.array([self.ids[p] for p in self.pieces], np.int32), np.array([len(p) for p in self.pieces], np.int32)
        raw = [bytes([int(self.names[i][1:-1], 16)]) if own.is_byte(i) else b"" if special[i] else self.names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.known_keys, self.known = np.full(CELLS, np.iinfo(np.uint64).max, np.uint64), np.zeros(CELLS, bool)

    def merge(self, text: str) -> list[str]:
        """The BPE encoding of a short text: the best-ranked pair of neighbours merges, the leftmost of equals, until none does."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def name(self, token: int) -> str:
        return chr(token - LOOSE) if token >= LOOSE else self.names[token]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of tokens, whether they stand side by side in the encoding of both together."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        cell = ((key * _P) >> np.uint64(43)).astype(np.int64)
        out = self.known[cell]
        new = np.flatnonzero(self.known_keys[cell] != key)
        if len(new):
            asked, at = np.unique(key[new], return_inverse=True)
            fits = np.array([self.side_by_side(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in asked])
            out[new] = fits[at.ravel()]
            cell = ((asked * _P) >> np.uint64(43)).astype(np.int64)
            self.known_keys[cell], self.known[cell] = asked, fits
        return out

    def side_by_side(self, left: int, right: int) -> bool:
        a, b = self.name(left), self.name(right)
        return self.merge(a + b) == [a, b]


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the first `depth` codes from there."""
    values, rank = np.unique(codes, return_inverse=True)
    rank, n, h = rank.ravel().astype(np.uint64) + np.uint64(1), len(codes), 1
    if len(values) < (1 << 16) - 1:  # four codes fit one key
        padded = np.concatenate([rank, np.zeros(3, np.uint64)])
        rank, h = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3], 4
    while True:
        order = np.argsort(rank)
        if h >= depth:
            return order
        own = rank[order]
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(np.concatenate([[1], (own[1:] != own[:-1]).astype(np.int64)])).astype(np.uint64)
        rank = (dense << np.uint64(32)) | np.concatenate([dense[h:], np.zeros(min(h, n), np.uint64)])
        h *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the range of the suffix array that begins with it: a binary search a character, for all pieces at once."""
    sizes = np.array([len(p) for p in pieces])
    deepest = int(sizes.max())
    letters = np.zeros((len(pieces), deepest), np.int64)
    flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    letters[np.arange(deepest)[None, :] < sizes[:, None]] = flat
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order))
    padded = np.concatenate([codes.astype(np.int64), np.full(deepest, -1)])
    for d in range(deepest):
        on = np.flatnonzero((sizes > d) & (lo < hi))
        if not len(on):
            break
        bounds = []
        for after in (0, 1):
            a, b = lo[on].copy(), hi[on].copy()
            todo = np.arange(len(on))
            while len(todo):
                mid = (a[todo] + b[todo]) >> 1
                below = padded[order[mid] + d] < letters[on[todo], d] + after
                a[todo[below]] = mid[below] + 1
                b[todo[~below]] = mid[~below]
                todo = todo[a[todo] < b[todo]]
            bounds.append(a)
        lo[on], hi[on] = bounds
    return lo, hi


def encode_chunks(m: Model, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after the other, and the number of ids of each."""
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(c) for c in chunks])
    codes = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(codes)
    separators = np.zeros(n, bool)
    separators[ends] = True
    order = suffix_array(np.where(separators, 0, codes + 1), m.depth)
    codes_ = np.where(separators, -2, codes.astype(np.int64))
    lo, hi = occurrences(codes_, order, m.pieces)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    small = np.int32 if n < 1 << 31 else np.int64
    at = np.arange(count.sum(), dtype=small)
    at += np.repeat((lo[found] - (np.cumsum(count) - count)).astype(small), count)
    place = order.astype(small)[at]
    token, length = np.repeat(m.piece_ids[found], count), np.repeat(m.piece_sizes[found], count)
    # characters that are no pieces
    single = np.zeros(n, bool)
    single[place[length == 1]] = True
    loose = np.flatnonzero(~single & ~separators)
    if len(loose):
        place, token = np.concatenate([place, loose.astype(small)]), np.concatenate([token, LOOSE + codes[loose].astype(np.int32)])
        length = np.concatenate([length, np.ones(len(loose), np.int32)])
    start_of = np.repeat(starts.astype(small), sizes + 1)
    step = place + length - start_of[place]  # characters of the chunk up to the edge's end
    deepest = int(step.max(initial=0))
    step = step.astype(np.uint16) if deepest < 1 << 16 else step  # 16-bit keys are sorted by radix
    by_end = np.argsort(step, kind="stable")
    place, token, length = place[by_end], token[by_end], length[by_end]
    cut = np.searchsorted(step[by_end], np.arange(1, deepest + 2))
    last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
    for a, b in zip(cut[:-1], cut[1:]):
        p, t, k = place[a:b], token[a:b], length[a:b]
        fits = p == start_of[p]
        inner = np.flatnonzero(~fits)
        fits[inner] = m.compatible(last[p[inner]], t[inner])
        last[p[fits] + k[fits]], back[p[fits] + k[fits]] = t[fits], k[fits]
    # from the chunks' ends back to their starts
    at, alive, steps = ends.copy(), np.flatnonzero(sizes > 0), []
    while len(alive):
        steps.append((alive, last[at[alive]]))
        at[alive] -= back[at[alive]]
        alive = alive[at[alive] > starts[alive]]
    chunk, made = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
    turn = np.concatenate([np.full(len(s[0]), i) for i, s in enumerate(steps)]) if steps else chunk
    order = np.lexsort((-turn, chunk))
    chunk, made = chunk[order], made[order]
    if (made >= LOOSE).any():
        per = [[m.byte[x] for x in chr(t - LOOSE).encode("utf-8", "surrogatepass")] if t >= LOOSE else [t] for t in made.tolist()]
        chunk = np.repeat(chunk, [len(x) for x in per])
        made = np.array([t for x in per for t in x], np.int64)
    return made, np.bincount(chunk, minlength=len(chunks))


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (each with the space before it) and the number of chunks of each."""
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, f"^ |  | $|{SPACE}").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts, " ")
    if odd.any() or empty.any():
        lists = split.to_pylist()
        for i in np.flatnonzero(odd):
            # without the leading space, as the plain ones
            lists[i] = [c.removeprefix(SPACE) for c in _CHUNK.findall(SPACE + texts[i].as_py().replace(" ", SPACE))]
        for i in np.flatnonzero(empty):
            lists[i] = []
        split = pa.array(lists, pa.list_(pa.string()))
    return split.flatten(), np.diff(split.offsets.to_numpy())


def encode(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the first place of each text among them (one more entry at the end)."""
    plain, per_text = chunks_of(texts)
    coded = plain.dictionary_encode()
    ids, count = encode_chunks(m, [SPACE + c for c in coded.dictionary.to_pylist()])
    first = np.cumsum(count) - count
    which = coded.indices.to_numpy()
    n = count[which]
    ends = np.cumsum(n)
    out = ids[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]


def decode(m: Model, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 of each text of ids, without the space that encoding adds."""
    n = m.size[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    raw = m.raw[np.repeat(m.first[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    at = ends[offsets]
    return [raw[s:e].removeprefix(b" ") for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def encoded(df: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, text): the ids of every row's text, and the text decoded from them."""
    return _over(df, path, id, text, "ids array<int>, decoded string", lambda ids, at, texts, raw: {"ids": [ids[s:e].astype(np.int32) for s, e in zip(at[:-1], at[1:])], "decoded": [r.decode("utf-8", "replace") for r in raw]})


def _over(df: DataFrame, path: str | None, id: str, text: str, added: str, result) -> DataFrame:
    path = path or default_model()
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches):
        m = model(path)
        for batch in gathered(batches, 1, BLOCK_BYTES):
            texts = batch.column(1).fill_null("")
            for s, e in slices((pc.binary_length(texts).to_numpy() + 1).tolist(), BLOCK_BYTES):
                part = texts.slice(s, e - s)
                ids, at = encode(m, part)
                made = rows(added, result(ids, at, part, decode(m, ids, at)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *made.columns], names=["id", *made.schema.names])

    return balanced(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {added}").withColumnRenamed("id", id)


def _digest(ids: np.ndarray, at: np.ndarray, texts: pa.Array, raw: list[bytes]) -> dict:
    wire = ids.astype("<u4")
    return {
        "n_pieces": np.diff(at),
        "ids_crc32": [zlib.crc32(wire[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())],
        "decoded_crc32": [zlib.crc32(r) for r in raw],
        "round_trip": [r == t.as_buffer().to_pybytes() for r, t in zip(raw, texts)],
    }


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents: pieces, checksums of the ids (little-endian unsigned 32-bit) and of the decoded UTF-8, and whether decoding gave the text back."""
    return _over(spark.read.parquet(f"{sf_dir}/documents.parquet"), None, "doc_id", "text", "n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean", _digest)
