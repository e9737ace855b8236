"""The language and quality models against plain versions of their rules, one text and one n-gram or word at a time."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stowage.llm import language_id, quality
from stowage.llm.common import is_train
from tests.conftest import DATA

from .data import odd_documents, rows_of

MASK = (1 << 64) - 1
P = 0x9E3779B97F4A7C15


def buckets_brute(text: str | None) -> tuple[int, list[int]]:
    """Number of letters, and the buckets of the text's n-grams."""
    shown = ""
    for c in f" {(text or '').lower()} ":
        if c.isalpha():
            shown += c
        elif not shown.endswith(" "):
            shown += " "
    out = []
    for n in (1, 2, 3):
        for i in range(len(shown) - n + 1):
            gram = shown[i : i + n]
            if n == 1 and gram == " ":
                continue
            h = 0
            for c in gram:
                h = (h * P + ord(c)) & MASK
            h ^= (h >> 29) ^ (n * 0x51ED27)
            out.append(((h * P) & MASK) >> 48)
    return sum(c != " " for c in shown), out


def fit_brute(rows: list[tuple], smooth: float = 0.1) -> tuple[list[str], dict]:
    """rows (text, lang): per language its log prior and log-probabilities by bucket."""
    counts, n = {}, {}
    for text, lang in rows:
        if text is None or lang is None:
            continue
        n[lang] = n.get(lang, 0) + 1
        letters, found = buckets_brute(text)
        if letters:
            own = counts.setdefault(lang, [smooth] * language_id.BUCKETS)
            for b in found:
                own[b] += 1
    total = sum(n[x] for x in counts)
    return sorted(counts), {x: (math.log(n[x] / total), np.log(np.array(counts[x]) / sum(counts[x]))) for x in counts}


def predict_brute(text: str | None, langs: list[str], model: dict) -> tuple[str, float, float]:
    """Language, posterior and evidence."""
    letters, found = buckets_brute(text)
    if not letters or not langs:
        return "und", 0.0, 0.0
    sums = [float(model[x][1][found].sum()) for x in langs]
    total = [s + model[x][0] for s, x in zip(sums, langs)]
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total), sums[best] / len(found) + language_id.SHORT / math.sqrt(len(found))


def test_language_is_that_of_the_plain_rules(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    train = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1
    langs, model = fit_brute([(d["text"], d["lang"]) for d in docs if train(d)])
    rows = {r["doc_id"]: r for r in rows_of(language_id.query(spark, DATA))}
    assert len(rows) == len(docs)
    for d in docs:
        lang, score, _ = predict_brute(d["text"], langs, model)
        assert rows[d["doc_id"]]["lang_pred"] == lang and rows[d["doc_id"]]["held_out"] == (not train(d))
        assert abs(rows[d["doc_id"]]["score"] - score) < 1e-3


def test_language_of_odd_rows_is_that_of_the_plain_rules(spark):
    df = odd_documents(spark)
    docs = rows_of(df)
    langs, model = fit_brute([(d["text"], d["lang"]) for d in docs])
    got = rows_of(language_id.predict(df, language_id.fit(df)))
    want = [predict_brute(d["text"], langs, model) for d in docs]
    assert [r["lang_pred"] for r in got] == [w[0] for w in want] and np.allclose([r["score"] for r in got], [w[1] for w in want], atol=1e-3)


def hash_brute(values: list[int]) -> int:
    h, power = 0, 1
    for v in values:
        power = power * P & MASK
        h = (h + (v + 1) * power) & MASK
    h ^= h >> 31
    return ((h * P) & MASK) >> 32


def kinds_brute(word: bytes) -> list[int]:
    out: list[int] = []
    for b in word:
        k = 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 16
        if not out or out[-1] != k:
            out.append(k)
    return out


def quality_brute(text: str | None, model: quality.Model) -> float:
    raw = (text or "").encode()
    words = [w for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    ids, shapes = [hash_brute(list(w)) % quality.WORDS for w in words], [hash_brute(kinds_brute(w)) % quality.SHAPES for w in words]
    mean = lambda table, at: sum((table[i].astype(float) for i in at), np.zeros(table.shape[1])) / max(len(at), 1)
    n = len(words)
    x = [*mean(model.words, ids), *mean(model.shapes, shapes), math.log1p(n) / 8, len(raw) / max(n, 1) / 8, len(set(ids)) / max(n, 1)]
    hidden = [math.tanh(sum(v * w for v, w in zip((np.array(x) - model.mean) / model.scale, column)) + b) for column, b in zip(model.w1.T, model.b1)]
    z = sum(h * w for h, w in zip(hidden, model.w2)) + model.b2
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z / model.temperature))))


def contexts_brute(texts: list[str], n: int, dim: int, seed: int, key) -> np.ndarray:
    """Sums of the index vectors of the neighbours within two places."""
    index, out = quality.index_vectors(n, dim, seed), np.zeros((n, dim))
    for t in texts:
        ids = [hash_brute(key(w)) % n for w in (t or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
        for i, a in enumerate(ids):
            for d in (1, 2):
                if i + d < len(ids):
                    out[a] += index[ids[i + d]]
                    out[ids[i + d]] += index[a]
    return out


def test_quality_is_that_of_the_plain_rules(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in rows_of(quality.query(spark, DATA))}
    for d in pq.read_table(f"{DATA}/documents.parquet").to_pylist():
        want = quality_brute(d["text"], model)
        assert abs(rows[d["doc_id"]]["score"] - want) < 1e-5 and rows[d["doc_id"]]["predicted"] == int(rows[d["doc_id"]]["score"] >= 0.5)


def test_random_indexing_is_that_of_the_plain_rules():
    texts = [r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()][:20] + ["", "one", "a a a"]
    words, shapes = quality.contexts(texts)
    assert np.allclose(words, contexts_brute(texts, quality.WORDS, quality.WORD_DIM, 7, list))
    assert np.allclose(shapes, contexts_brute(texts, quality.SHAPES, quality.SHAPE_DIM, 8, kinds_brute))


def test_held_out_rows_teach_nothing(spark):
    """Other texts and labels of held-out rows change no score of the others."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(is_train("doc_id", 3, 1), F.col("lang")).otherwise("xx"))
    a, b = (language_id.fit(d.where(is_train("doc_id", 3, 1))) for d in (docs, other))
    assert a.langs == b.langs and (a.logp == b.logp).all()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    swapped = labels.withColumn("quality", F.when(is_train("doc_id", 3, 1), F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality.fit(docs, labels).score(["some text", ""]).tolist() == quality.fit(docs, swapped).score(["some text", ""]).tolist()
