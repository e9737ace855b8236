"""The pipeline, stage by stage and as a whole, against plain versions of the stages' rules on the stages' own inputs."""

from __future__ import annotations

import math
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from stowage.llm import language_id, packing, quality, queries, simhash
from tests.conftest import DATA

from .data import odd_documents, rows_of
from .test_models import fit_brute, predict_brute, quality_brute
from .test_text import dedup_brute, unpacked

key = lambda r: repr(sorted((k, v) for k, v in r.items()))


def language_brute(rows: list[dict]) -> list[dict]:
    train = [r for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    langs, model = fit_brute([(r["text"], r["lang"]) for r in train])
    seen: dict = {}
    for r in train:
        lang, _, evidence = predict_brute(r["text"], langs, model)
        if lang != "und":
            seen.setdefault(lang, []).append(evidence)
    floors = {}
    for lang, x in seen.items():
        mid, low = (sorted(x)[math.ceil(p * len(x)) - 1] for p in (0.5, 0.25))
        floors[lang] = mid - language_id.SPREADS * max(language_id.LEAST_SPREAD, mid - low)
    out = []
    for r in rows:
        lang, _, evidence = predict_brute(r["text"], langs, model)
        if lang != "und" and evidence >= floors.get(lang, min(floors.values())) - 1e-4:
            out.append(r)
    return out


def sets(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_brute(rows: list[dict]) -> list[str]:
    """All pairs of different sets; of each component the least row."""
    own = [sets(r["text"]) for r in rows]
    distinct = list(dict.fromkeys(own))
    parent = {s: s for s in distinct}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            small, large = sorted((len(a), len(b)))
            if small >= 0.8 * large and len(a & b) >= 0.8 * len(a | b) and (a or b):
                parent[find(a)] = find(b)
    groups: dict = {}
    for r, s in zip(rows, own):
        groups.setdefault(find(s), []).append(r)
    ids = lambda g: [r["doc_id"] for r in g if r["doc_id"] is not None]
    return [(min(ids(g)) if ids(g) else None, g) for g in groups.values()]


def check(spark, docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "lines", "near_copies", "packing"]
    good = stages["quality"](spark, docs, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(map(key, rows_of(good))) == sorted(key(r) for r in rows_of(docs) if quality_brute(r["text"], model) >= 0.5)
    known = stages["language"](spark, good, sf_dir)
    assert sorted(map(key, rows_of(known))) == sorted(map(key, language_brute(rows_of(good))))
    lines = stages["lines"](spark, known, sf_dir)
    before = rows_of(known)
    want = []
    for r, t in zip(before, dedup_brute([r["text"] for r in before], 10)):
        want.append(r if t == (r["text"] or "") else {**r, "text": t, "n_chars": len(t)})
    assert sorted(map(key, rows_of(lines))) == sorted(map(key, want))
    left = stages["near_copies"](spark, lines, sf_dir)
    kept = rows_of(left)
    groups = near_brute(rows_of(lines))
    assert len(kept) == len(groups)
    for least, members in groups:
        own = [r for r in kept if key(r) in set(map(key, members))]
        assert len(own) == 1 and own[0]["doc_id"] == least
    for s in (good, known, lines, left):
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    packed = rows_of(stages["packing"](spark, left, sf_dir))
    unpacked(packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows_of(left)}
    return kept


def test_stages(spark):
    check(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)


def test_stages_on_odd_rows(spark):
    check(spark, odd_documents(spark), DATA)


def test_run(spark):
    """run() gives the pieces of the documents that plain versions of the stages keep, one after the other."""
    rows = rows_of(corpus_pipeline.run(spark, DATA))
    unpacked(rows)
    docs = rows_of(spark.read.parquet(f"{DATA}/documents.parquet"))
    model = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    docs = language_brute([r for r in docs if quality_brute(r["text"], model) >= 0.5])
    docs = [{**r, "text": t} for r, t in zip(docs, dedup_brute([r["text"] for r in docs], 10))]
    text = {r["doc_id"]: r["text"] for r in docs}
    stay = {least for least, _ in near_brute(docs)}
    encode = packing.encoder(packing.vocabulary())
    assert {r["doc_id"] for r in rows} == stay
    lengths: dict = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(encode(text[d] or "")) + 1 for d in stay}
    assert "pipeline" not in queries.QUERIES


CLASHES = ["Text_", "kept_text", "N_LINES", "n_dropped", "line_mark", "LINE_SIZE", "line_drops", "drops", "mark", "quality_score", "Quality_Predicted", "score", "Predicted", "lang_pred", "LANG_SCORE", "lang_evidence", "near_set", "Near_Bands", "near_row", "row", "root", "best", "bands", "a.b", "piece", "LENGTH", "_stowage_mark"]


@pytest.mark.parametrize("stage", ["quality", "language", "lines", "near_copies"])
def test_stages_keep_columns_whose_names_clash(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHES], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    stages = dict(corpus_pipeline.STAGES)
    plain, got = rows_of(stages[stage](spark, docs, DATA)), stages[stage](spark, wide, DATA)
    assert got.columns == wide.columns
    rows = rows_of(got)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain) and plain
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHES)


def test_operators_replace_columns_whose_names_clash(spark):
    """Result columns replace columns of the same name, as the session compares names."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 30").selectExpr("doc_id", "text", "lang", "1 as Score", "2 as LANG_PRED", "3 as Predicted", "4 as Kept_Text")
    assert language_id.predict(docs, language_id.fit(docs)).select("score", "lang_pred").dtypes == [("score", "double"), ("lang_pred", "string")]
    assert quality.predict(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).select("score", "predicted").dtypes == [("score", "double"), ("predicted", "int")]
    assert simhash.near_copies(docs).columns == docs.columns


def test_language_stage_by_wanted_languages_and_score(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    every, some = (rows_of(language_id.known(docs, docs, languages=x)) for x in (None, ("en", "fr")))
    lang = {r["doc_id"]: r["lang_pred"] for r in rows_of(language_id.predict(docs, language_id.fit(docs)))}
    assert sorted(r["doc_id"] for r in some) == sorted(r["doc_id"] for r in every if lang[r["doc_id"]] in ("en", "fr")) and 0 < len(some) < len(every)
    assert language_id.known(docs, docs, min_score=1.1).count() == 0
    assert language_id.known(docs, docs.limit(0)).count() == 0
