"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and runs of non-letters become one space. N-grams of 1 to 3 characters are hashed into BUCKETS
cells. The model is one log-probability row per language; its size depends on the number of languages, never on the
corpus, so it is broadcast. A batch is scored as sparse rows: bucket numbers with document offsets.

The pipeline's stage also rejects on the model's evidence, the mean log-probability per n-gram under the best language.

Defined cases: a null text, or one without a letter, is `und` with score 0. Rows with null language or without a letter
teach nothing. With nothing learned every text is `und`. Equal scores go to the language first in alphabetical order.
Rows that repeat are rows of their own; an empty table gives no rows. Texts are whole, in pieces of memory of about CHUNK
characters a task, or one longer text. Other columns pass through; a result column replaces one of the same name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, frame, free, is_train, map_batches, own_columns, rows, slices, squeeze, texts_of, unframe

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the training sample: documents per language, chosen by a hash of the id.
PER_LANGUAGE = 5_000
#: Bound of the model: so many languages, those with the most rows, are learned.
LANGUAGES = 1_000
#: Characters handled at once, to bound memory; a longer text stands alone.
CHUNK = 1 << 17
#: The stage's least evidence (see floors) and the allowance for texts of few n-grams.
SPREADS, LEAST_SPREAD, SHORT = 16, 0.15, 6.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() if not 0xD800 <= i < 0xE000 else 0 for i in range(0x110000)), np.bool_)


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each text the number of letters, and for each order the buckets and the first place of each text among them."""
    lowered = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    first = np.zeros(len(c), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    # of a run of non-letters its first character stays, as a space
    stays = letter | np.concatenate([[True], letter[:-1]]) | first
    code = np.where(letter, c, 32)[stays].astype(np.uint64)
    doc, letter = doc[stays], letter[stays]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    found, h = [], np.zeros(len(code), np.uint64)
    for n in ORDERS:
        h = (h[: len(code) - n + 1] * _STEP if n > 1 else h) + code[n - 1 :]
        if n > 1:
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
        else:
            same = letter
        x = h[same]
        x = x ^ (x >> np.uint64(29)) ^ np.uint64(n * 0x51ED27)
        found.append((((x * _STEP) >> np.uint64(48)).astype(np.int64), np.searchsorted(doc[n - 1 :][same], np.arange(len(texts) + 1))))
    return n_letters, found, ends


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.float64)
    return out


def score_texts(texts: list[str], langs: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Of each text its language, the posterior probability, and the evidence: the mean log-probability of its n-grams
    under that language, with an allowance of SHORT over the root of their number."""
    pred: list[str] = []
    score: list[float] = []
    evidence: list[float] = []
    for s, e in slices([len(t) + 2 for t in texts], CHUNK):
        n_letters, found, _ = ngrams(texts[s:e])
        total = np.tile(prior, (e - s, 1))
        for buckets, offsets in found:
            for k in range(len(langs)):
                total[:, k] += _sum_by(logp[k][buckets], offsets)
        best = total.argmax(axis=1) if langs else np.zeros(e - s, int)
        if langs:
            p = np.exp(total - total.max(axis=1, keepdims=True))
            sure = 1 / p.sum(axis=1)
            n = np.maximum(1, sum(np.diff(offsets) for _, offsets in found))
            mean = (total.max(axis=1) - prior[best]) / n + SHORT / np.sqrt(n)
        known = (n_letters > 0) & bool(langs)
        pred += [langs[b] if k else "und" for b, k in zip(best, known)]
        score += [float(sure[i]) if k else 0.0 for i, k in enumerate(known)]
        evidence += [float(mean[i]) if k else 0.0 for i, k in enumerate(known)]
    return pred, score, evidence


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
        for s, e in slices([len(t) + 2 for t in texts], CHUNK):
            n_letters, found, _ = ngrams(texts[s:e])
            for buckets, offsets in found:
                for i in range(e - s):
                    if n_letters[i]:
                        total.setdefault(langs[s + i], np.zeros(BUCKETS, np.uint32))
                        np.add.at(total[langs[s + i]], buckets[offsets[i] : offsets[i + 1]], np.uint32(1))
    for lang, x in total.items():
        at = np.flatnonzero(x)
        yield rows("lang string, counts binary", {"lang": [lang], "counts": [frame([squeeze(np.diff(at, prepend=0).astype("<u4")), squeeze(x[at].astype("<u4"))])]})


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    x = np.zeros(BUCKETS, np.int64)
    for b in table.column("counts").to_pylist():
        at, n = unframe(b)
        x[np.cumsum(expand(at, "<u4"))] += expand(n, "<u4")
    return pa.table({"lang": [key[0].as_py()], "counts": pa.array([x.astype("<i8").tobytes()], pa.binary())})


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = PER_LANGUAGE, smooth: float = 0.1, languages: int = LANGUAGES) -> Model:
    """Learns the `languages` languages with the most rows, from at most about per_language rows of each, whole texts, chosen by a hash of the id."""
    rows_ = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    n = {r["lang"]: r["n"] for r in rows_.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not n:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, per_language / v))])
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20))
    sample = rows_.where(F.map_contains_key(share, F.col("lang")) & (place < F.try_element_at(share, F.col("lang")) * (1 << 20)))
    parts = sample.select("text", "lang").mapInArrow(_count, "lang string, counts binary")
    got = sorted(parts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect(), key=lambda r: r["lang"])
    if not got:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    counts = np.stack([np.frombuffer(r["counts"], "<i8") for r in got]).astype(float) + smooth
    langs = [r["lang"] for r in got]
    weight = np.array([n[x] for x in langs], float)
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(weight / weight.sum()))


def predict(df: DataFrame, model: Model, text: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its posterior probability to every row, and the evidence if `into` has a third name."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior))
    at = df.columns.index(text)

    def run(batch):
        langs, logp, prior = shared.value
        return dict(zip(into, score_texts(texts_of(batch.column(at)), langs, logp, prior)))

    return map_batches(df, ", ".join(f"{name} {kind}" for name, kind in zip(into, ("string", "double", "double"))), run)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = is_train("doc_id", 3, 1)
    model = fit(docs.where(train))
    return predict(docs.select("doc_id", "text", (~train).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def floors(df: DataFrame, model: Model, text: str = "text") -> dict[str, float]:
    """The least evidence of each language, from all rows of df: SPREADS times the distance from median to lower quartile
    (LEAST_SPREAD at least) below the median, so that less than a quarter of a language's rows may be junk. A language that no row
    is predicted as has the lowest of the floors."""
    source = df.select(F.col(text).alias("text"))
    scored = predict(source, model, into=("lang", "score", "evidence")).where("lang <> 'und'")
    found = scored.groupBy("lang").agg(F.percentile_approx("evidence", [0.5, 0.25], 10_000)).collect()  # a row a learned language
    made = {lang: mid - SPREADS * max(LEAST_SPREAD, mid - low) for lang, (mid, low) in found}
    return {lang: made.get(lang, min(made.values())) for lang in model.langs} if made else {}


def known(docs: DataFrame, train: DataFrame, text: str = "text", languages: tuple[str, ...] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of docs in one of `languages` (any learned one if None), with a posterior probability of min_score or more
    and evidence that reaches the language's floor. Texts without a letter go; so do all if nothing was learned from train."""
    model = fit(train, text)
    least = floors(train, model, text)
    if not least:
        return docs.where("false")
    names = free(docs, "lang_pred", "lang_score", "lang_evidence")
    lang, score, evidence = (F.col(n) for n in names)
    floor = F.create_map(*[F.lit(x) for item in least.items() for x in item])
    good = (lang != "und") & (score >= min_score) & (evidence >= floor[lang])
    if languages is not None:
        good &= lang.isin(*languages)
    return predict(docs, model, text, tuple(names)).where(good).select(*own_columns(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose evidence for their best language is below that language's floor:
    letter junk and text in no learned language. Clean documents of any learned language stay."""
    return known(docs, docs.where(is_train("doc_id", 3, 1)))
