"""Files from their blocks, job totals and running progress. Only numbers are gathered, never payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.crc import combine_col
from ..shared import keep

#: Blocks of a file whose checksums are combined in one step.
FAN = 1 << 10


def _fold(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """parts(keys, order, blocks, crc32, uncompressed, compressed) to one row per keys: checksums combine in order, numbers add up."""
    ordered = F.sort_array(F.collect_list(F.struct(order, "crc32", "uncompressed")))
    crc = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.element_at("_parts", 1)["crc32"], lambda whole, b: combine_col(whole, b["crc32"], b["uncompressed"]))
    sums = parts.groupBy(*keys).agg(ordered.alias("_parts"), *[F.sum(c).alias(c) for c in ("blocks", "uncompressed", "compressed")])
    return sums.select(*keys, "blocks", F.when(F.size("_parts") == 1, F.element_at("_parts", 1)["crc32"]).otherwise(crc).alias("crc32"), "uncompressed", "compressed")


def assemble(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """blocks(file_id, block_index, crc32, uncompressed, compressed) to one row per file with the whole file's CRC.

    Checksums combine in ranges of `fan` blocks first, then over a file's ranges, so the blocks of a large file are spread
    over tasks and no list is longer than `fan` blocks or a file's ranges.
    """
    parts = blocks.select("file_id", "block_index", F.lit(1).cast("long").alias("blocks"), "crc32", "uncompressed", "compressed").withColumn("_range", F.floor(F.col("block_index") / F.lit(fan)))
    whole = _fold(_fold(parts, ["file_id", "_range"], "block_index"), ["file_id"], "_range")
    return whole.select("file_id", F.col("blocks").cast("int").alias("blocks"), F.col("crc32").alias("file_crc32"), "uncompressed", "compressed")


def ratio(uncompressed: Column, compressed: Column) -> Column:
    """Compressed over uncompressed bytes; null without input."""
    return F.when(uncompressed > 0, compressed / uncompressed)


def saved_percent(uncompressed: Column, compressed: Column) -> Column:
    """The share of bytes saved, in per cent; null without input."""
    return 100 * (1 - ratio(uncompressed, compressed))


def before(df: DataFrame, value: Column | str, order: str, into: str, bucket: int = 1 << 17) -> DataFrame:
    """Adds the sum of `value` over the rows with a smaller `order` (a long, distinct)."""
    return all_before(df, {into: value}, order, bucket)


def all_before(df: DataFrame, values: dict[str, Column | str], order: str, bucket: int = 1 << 17) -> DataFrame:
    """Adds for each name the sum of its value over the rows with a smaller `order` (a long, distinct).

    Rows are summed by ranges of `order` first; only the ranges' sums go through one window, so no task sees all rows.
    """
    own = {f"_value{k}": (F.col(v) if isinstance(v, str) else v).cast("long") for k, v in enumerate(values.values())}
    rows = df.withColumns(own).withColumn("_range", F.floor(F.col(order) / F.lit(bucket)))
    sums = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in own])
    starts = sums.select("_range", *[(F.sum(c).over(W.orderBy("_range")) - F.col(c)).alias(f"_start{c}") for c in own])
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumns({f"_own{c}": F.sum(c).over(inside) - F.col(c) for c in own}).join(starts, "_range")
    placed = placed.withColumns({into: F.col(f"_start{c}") + F.col(f"_own{c}") for into, c in zip(values, own)})
    return placed.drop("_range", *own, *[f"{x}{c}" for c in own for x in ("_own", "_start")])


def numbered(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Numbers rows from 0 by the keys. Rows are dealt to ranges of the keys, written once so that the ranges stay what they
    are, and numbered within them; only one count a range goes through one window."""
    ranged = keep(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_own", own).join(starts, "_range").withColumn(into, (F.col("_start") + F.col("_own")).cast("long")).drop("_own", "_start", "_range")


def job_stats(files: DataFrame) -> DataFrame:
    """files(uncompressed, compressed, blocks, route) to one row."""
    of = lambda r: F.coalesce(F.sum(F.when(F.col("route") == r, F.col("blocks"))), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.agg(F.count("*").alias("files_processed"), F.lit(0).cast("long").alias("files_skipped"), total("uncompressed").alias("input_bytes"), total("compressed").alias("output_bytes"), of("Cpu").alias("cpu_blocks"), of("Gpu").alias("gpu_blocks"))


def progress(files: DataFrame, bucket: int = 1 << 17) -> DataFrame:
    """files(ordinal, size_bytes, compressed) with what is done after each: files, bytes, output bytes and percent."""
    done = all_before(files, {"_bytes": "size_bytes", "_files": F.lit(1), "_output": "compressed"}, "ordinal", bucket)
    rows = done.withColumn("total_files", files.agg(F.count("*")).scalar()).withColumn("total_bytes", files.agg(F.sum("size_bytes")).scalar())
    bytes_ = F.col("_bytes") + F.col("size_bytes")
    percent = F.when(F.col("total_bytes") > 0, 100 * bytes_ / F.col("total_bytes")).otherwise(F.lit(0.0))
    output = F.col("_output") + F.col("compressed")
    return rows.select("ordinal", (F.col("_files") + 1).alias("processed_files"), bytes_.alias("processed_bytes"), output.alias("output_bytes"), "total_files", "total_bytes", F.round(percent, 6).alias("percent"))
