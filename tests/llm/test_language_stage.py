"""The pipeline's language stage on planted junk."""

from __future__ import annotations

import random

from stowage.llm import language_id
from tests.conftest import DATA

from .data import rows_of


def test_letter_junk_and_unlearned_text_leave(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(6)
    junk = [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "qxzwkjv", "éüñßçö") for n in (20, 60, 200)]
    junk += ["Съешь же ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ つねならむ"]
    plants = spark.createDataFrame([(10**6 + i, t, "en") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in rows_of(language_id.stage(spark, docs.union(plants), DATA))}
    assert not [i for i in range(len(junk)) if 10**6 + i in kept]
    assert {r["doc_id"] for r in rows_of(docs)} <= kept


def test_short_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    short = [(10**6 + r["doc_id"], " ".join(r["text"].split()[:3]), r["lang"]) for r in rows_of(docs) if len(r["text"].split()) > 2]
    plants = spark.createDataFrame(short, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in rows_of(language_id.stage(spark, docs.union(plants), DATA))}
    assert sum(d in kept for d, _, _ in short) >= 0.98 * len(short)
