"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Each token has two hashed features: the word itself and its shape (runs of letter cases, digits and marks). Every
feature bucket owns a sparse ternary index vector; its context vector is the sum of the index vectors seen next to it
in the training sample, scaled to length 1. A document is the mean of the context vectors of its words, the mean of the
index and context vectors of its shapes, and three counts. Index tables have a fixed number of buckets, so the model is
small whatever the corpus.

Defined cases: a null text counts as empty; empty texts get the network's answer for the zero vector. Without labelled
rows of both classes every score is the share of label 1 (0.5 without any label). Rows that repeat are scored each, and
teach once an id; a null id teaches nothing; an empty table gives no rows. Texts are whole, in pieces of memory of about
CHUNK characters a task, or one longer text. Other columns pass through; a result column replaces one of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, expand, free, is_train, map_batches, own_columns, rows, slices, squeeze, texts_of

WORDS, SHAPES = 1 << 15, 1 << 10
WORD_DIM, SHAPE_DIM = 32, 48
HIDDEN = 24
#: Bound of the training sample: labelled documents per class, chosen by a hash of the id.
PER_CLASS = 4_000
#: Tasks that the sample is spread over.
PARTS = 8
CHUNK = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes: lower case and bytes beyond ASCII 1, upper case 2, digits 3, each mark its own.
_KIND = np.arange(256, dtype=np.uint64) + np.uint64(16)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def _hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _P, np.uint64))
    h = np.add.reduceat((values + np.uint64(1)) * powers[place], starts)
    h ^= h >> np.uint64(31)
    return (h * _P) >> np.uint64(32)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets and the first token of each text (one more entry at the end)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    solid = ~_SPACE[joined]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.searchsorted(starts, doc_end)])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    lengths = ends - starts
    own = joined[solid].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word = _hash(own, first, lengths)
    kind = _KIND[own]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    new[first] = True
    runs = np.add.reduceat(new.astype(np.int64), first)
    shape = _hash(kind[new], np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
    return (word % np.uint64(WORDS)).astype(np.int64), (shape % np.uint64(SHAPES)).astype(np.int64), offsets


def index_vectors(n: int, dim: int, seed: int, nonzero: int = 6) -> np.ndarray:
    """Sparse ternary rows, the same on every machine."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, dim), np.float32)
    for _ in range(nonzero):
        out[np.arange(n), draw.integers(0, dim, n)] += draw.choice(np.array([-1, 1], np.float32), n)
    return out


def context_vectors(ids: np.ndarray, offsets: np.ndarray, index: np.ndarray, window: int = 2) -> np.ndarray:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros_like(index)
    for d in range(1, window + 1):
        if len(ids) <= d:
            break
        same = doc[d:] == doc[:-d]
        a, b = ids[:-d][same], ids[d:][same]
        for to, of in ((a, b), (b, a)):
            for k in range(index.shape[1]):
                out[:, k] += np.bincount(to, index[of, k], minlength=len(index)).astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _mean(table: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(table[ids], offsets[:-1][full], axis=0) / np.diff(offsets)[full, None]
    return out


def pool(texts: list[str], words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    out = []
    for s, e in slices([len(t) + 1 for t in texts], CHUNK):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[s:e]]
        w, h, at = tokens(raw)
        n = np.diff(at)
        extra = np.stack([np.log1p(n) / 8, np.array([len(r) for r in raw]) / np.maximum(n, 1) / 8, [len(np.unique(w[a:b])) / max(b - a, 1) for a, b in zip(at[:-1], at[1:])]], axis=1)
        out.append(np.concatenate([_mean(words, w, at), _mean(shapes, h, at), extra], axis=1))
    return np.concatenate(out) if out else np.zeros((0, words.shape[1] + shapes.shape[1] + 3))


class Model:
    def __init__(self, words, shapes, mean, scale, w1, b1, w2, b2, temperature, constant=None):
        self.words, self.shapes, self.mean, self.scale = words, shapes, mean, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature, self.constant = w1, b1, w2, b2, temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pool(texts, self.words, self.shapes)) / self.temperature, -40, 40)))


def contexts(texts: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the index vectors seen next to each word and each shape."""
    index = index_vectors(WORDS, WORD_DIM, seed), index_vectors(SHAPES, SHAPE_DIM, seed + 1)
    out = np.zeros_like(index[0]), np.zeros_like(index[1])
    for s, e in slices([len(t) + 1 for t in texts], CHUNK):
        w, h, at = tokens([t.encode("utf-8", "surrogatepass") for t in texts[s:e]])
        for sums, ids, table in zip(out, (w, h), index):
            sums += context_vectors(ids, at, table)
    return out


def vectors(words: np.ndarray, shapes: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and shapes from their context sums."""
    return _unit(words), np.concatenate([index_vectors(SHAPES, SHAPE_DIM, seed + 1) / np.sqrt(6), _unit(shapes)], axis=1).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, words: np.ndarray | None, shapes: np.ndarray | None, seed: int = 7, epochs: int = 60) -> Model:
    """The network on pooled documents. One fifth of them is kept from it to fit the temperature."""
    if not len(y) or y.min() == y.max():
        return Model(*[None] * 9, constant=float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    draw = np.random.Generator(np.random.PCG64(seed))
    held = draw.permutation(len(y)) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    d = x.shape[1]
    p = [draw.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    xs, ys = ((x - mean) / scale)[~held], y[~held].astype(float)
    share = ys.mean()
    weight = np.where(ys == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(epochs):
        order = draw.permutation(len(ys))
        for a in range(0, len(ys), 128):
            k = order[a : a + 128]
            hidden = np.tanh(xs[k] @ p[0] + p[1])
            g = weight[k] * (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - ys[k]) / len(k)
            back = np.outer(g, p[2]) * (1 - hidden**2)
            grads = [xs[k].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ g + 1e-4 * p[2], g.sum()]
            step += 1
            for j, grad in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad**2
                p[j] = p[j] - 0.005 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    model = Model(words, shapes, mean, scale, *p, temperature=1.0)
    if held.any():
        z, t = model.logits(x[held]), y[held]
        # a unit normal prior on log temperature: a small sample that the network separates says little about how sure it may be
        loss = lambda c: np.logaddexp(0, np.where(t == 1, -z, z) / c).sum() + np.log(c) ** 2 / 2
        model.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return model


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from at most about per_class labelled rows of each class, whole texts, chosen by a hash of the id."""
    marked = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20))
    few = marked.where(place < F.when(F.col("label") == 1, per_class / max(1, n.get(1, 0))).otherwise(per_class / max(1, n.get(0, 0))) * (1 << 20))
    few = few.where(is_train("id", 3, 1))
    # at most two classes of about per_class ids, so the broadcast is bounded; of rows that repeat an id one teaches
    taught = df.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = Kept(taught.repartition(PARTS, "id"), "quality-sample").df

    def count(batches):
        sums = [contexts(texts_of(b.column(0))) for b in batches if b.num_rows]
        if sums:
            yield rows("words binary, shapes binary", {"words": [squeeze(sum(s[0] for s in sums).ravel())], "shapes": [squeeze(sum(s[1] for s in sums).ravel())]})

    # a few tables and vectors of fixed size come to the driver, whatever the texts' lengths
    parts = sorted(sample.select("text").mapInArrow(count, "words binary, shapes binary").collect())
    sums = [sum((expand(p[c], "<f4").astype(np.float64) for p in parts), np.zeros(n * d)).reshape(n, d) for c, n, d in (("words", WORDS, WORD_DIM), ("shapes", SHAPES, SHAPE_DIM))]
    tables = vectors(*sums)
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def pooled(batches):
        for b in batches:
            if b.num_rows:
                x = pool(texts_of(b.column(0)), *shared.value)
                yield rows("label int, id string, x binary", {"label": b.column(1).to_pylist(), "id": [str(i) for i in b.column(2).to_pylist()], "x": [v.tobytes() for v in x]})

    got = sorted(sample.select("text", "label", "id").mapInArrow(pooled, "label int, id string, x binary").collect(), key=lambda r: r["id"])
    return train(np.array([np.frombuffer(r["x"]) for r in got]), np.array([r["label"] for r in got], int), *tables)


def predict(df: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the probability of label 1 and the class to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batch):
        score = shared.value.score(texts_of(batch.column(at)))
        return {into[0]: score, into[1]: (score >= 0.5).astype(np.int32)}

    return map_batches(df, f"{into[0]} double, {into[1]} int", run)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    return predict(docs.select("doc_id", "text", (~is_train("doc_id", 3, 1)).alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be of label 0."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free(docs, "quality_score", "quality_predicted")
    return predict(docs, model, into=tuple(names)).where(F.col(names[1]) == 1).select(*own_columns(docs))
