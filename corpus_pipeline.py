"""A training corpus from documents: quality, language, repeated lines, near copies, packing.

Each stage works on all that the one before kept, written as Parquet in the shared folder and read again. Quality and
language reject documents, line dedup rewrites texts, near_copies keeps the document with the smallest id of each group of
near copies (similarity of 0.8 or more over five words), and packing gives the pieces with their places in the sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import language_id, line_dedup, packing, quality, simhash
from stowage.shared import Kept, scratch
from stowage.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality", _shipped(quality.stage)),
    ("language", _shipped(language_id.stage)),
    ("lines", _shipped(line_dedup.stage)),
    ("near_copies", _shipped(simhash.stage)),
    ("packing", _shipped(packing.stage)),
]

#: Trained models and fingerprints are not expressible in SQL; tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps for itself goes when its result is written, and that when the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as spare:
            made = spare(Kept(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last:
            last.drop()
        docs, last = made.df, made
    return docs
