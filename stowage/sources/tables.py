"""The driver's tables as files and blocks to pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """file_id, source, lang, file_name, archive_path, size_bytes and, if asked for, payload (UTF-8)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), raw.alias("payload")
    )
    files = docs.withColumn("archive_path", F.concat_ws("/", "source", "lang", "file_name")).withColumn("size_bytes", F.octet_length("payload").cast("long"))
    return files if payload else files.drop("payload")


def ordered(files: DataFrame) -> DataFrame:
    """Adds ordinal, from 0, in the order of the paths' components."""
    return numbered(files, ["source", "lang", "file_name", "file_id"], "ordinal")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that come split: a conversation is a file and a turn a block. payload only travels where it is selected."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("block_index"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
