"""Block split and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MIB, Algorithm


def block_count(size: Column, block_bytes: int) -> Column:
    """An empty file has one block."""
    up = size + F.lit((block_bytes or MIB) - 1)
    return F.greatest(F.lit(1).cast("long"), ((up - F.pmod(up, F.lit(block_bytes or MIB))) / F.lit(block_bytes or MIB)).cast("long"))


def split(files: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block of files(file_id, size_bytes, ...): block_index, logical_offset, used_bytes, is_last. Other columns pass through."""
    b = block_bytes or MIB
    n = block_count(F.col("size_bytes"), b)
    rows = files.withColumn("_n", n).withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    offset = F.col("block_index") * b
    return rows.select(
        *files.columns,
        F.col("block_index").cast("int").alias("block_index"),
        offset.alias("logical_offset"),
        F.least(F.lit(b).cast("long"), F.col("size_bytes") - offset).alias("used_bytes"),
        (F.col("block_index") == F.col("_n") - 1).alias("is_last"),
    )


def read(blocks: DataFrame, payload: str = "payload") -> DataFrame:
    """Replaces the whole payload of each block's row by the block's bytes."""
    return blocks.withColumn(payload, F.substring(F.col(payload), (F.col("logical_offset") + 1).cast("int"), F.col("used_bytes").cast("int")))


def route(size: Column, algorithm: Column | Algorithm, gpu: Column | bool, threshold: Column | int) -> Column:
    """'Cpu' or 'Gpu'; the threshold is inclusive."""
    algorithm = F.lit(int(algorithm)) if isinstance(algorithm, Algorithm) else algorithm
    gpu = F.lit(gpu) if isinstance(gpu, bool) else gpu
    return (
        F.when(~gpu, "Cpu")
        .when(algorithm == int(Algorithm.CPU_DEFLATE), "Cpu")
        .when(algorithm.isin(int(Algorithm.GPU_DEFLATE), int(Algorithm.GPU_GDEFLATE)), "Gpu")
        .when(size >= threshold, "Gpu")
        .otherwise("Cpu")
    )
