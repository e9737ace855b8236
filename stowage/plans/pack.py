"""The pack job: scan, blocks, deflate, assemble, layout, write."""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MIB, EngineOptions, Format, JobOptions, JobRequest, JobStats, Level, PackError, Progress, Status
from ..operators.assemble import assemble, job_stats
from ..operators.blocks import route
from ..operators.codec import MADE, check, deflated, packed
from ..shared import Kept
from ..ship import ship
from ..sources import archives
from ..sources.files import BATCH_BYTES, plan, read_ahead, scan
from ..streaming.progress import Throttle

log = logging.getLogger("stowage")


def validate(request: JobRequest) -> None:
    if not request.inputs:
        raise PackError(Status.INVALID_ARGUMENT, "no inputs")
    if not request.output:
        raise PackError(Status.INVALID_ARGUMENT, "no output")


def compressed(source: DataFrame, options: JobOptions) -> DataFrame:
    """blocks(file_id, block_index, is_last, payload) with bytes, crc32 and sizes; the payload goes."""
    return deflated(source, options.level)


class Counters:
    """What tasks have done so far. A task that runs twice counts twice, so what is shown never exceeds the totals."""

    def __init__(self, spark: SparkSession):
        self.files, self.read, self.written = (spark.sparkContext.accumulator(0) for _ in range(3))

    def show(self, progress: Throttle, files: int, size: int) -> None:
        progress.update(processed_files=min(files, self.files.value), processed_bytes=min(size, self.read.value), output_bytes=self.written.value)


def compress_files(blocks: DataFrame, level: Level, io_threads: int, files: Accumulator, read: Accumulator, written: Accumulator) -> DataFrame:
    """plan() of a manifest to deflated blocks. Bytes are read and compressed in the same task, `io_threads` blocks ahead, and
    leave it in batches of about BATCH_BYTES; only compressed bytes reach the JVM."""

    def run(batches):
        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            parts = read_ahead(list(zip(col["source"], col["logical_offset"], col["used_bytes"])), io_threads)
            s, n = 0, b.num_rows
            while s < n:
                e, held = s, 0
                while e < n and (e == s or held + col["used_bytes"][e] <= BATCH_BYTES):
                    held += col["used_bytes"][e]
                    e += 1
                made = packed(pa.array(col["file_id"][s:e], pa.int64()), pa.array(col["block_index"][s:e], pa.int32()), col["file_id"][s:e], col["is_last"][s:e], [next(parts) for _ in range(s, e)], level)
                files.add(sum(col["is_last"][s:e]))
                read.add(held)
                written.add(sum(made.column("compressed").to_pylist()))
                yield made
                s = e

    return blocks.mapInArrow(run, f"file_id long, block_index int, {MADE}")


def watched(job: Callable[[], Kept], step: Callable[[], None], every: float = 0.05) -> Kept:
    """The job's result; while it runs, step() again and again on a thread of its own."""
    over = threading.Event()

    def look() -> None:
        while not over.wait(every):
            step()

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        return job()
    finally:
        over.set()
        thread.join()


def run(spark: SparkSession, request: JobRequest, engine: EngineOptions = EngineOptions(), on_progress: Callable[[Progress], None] | None = None, gpu_available: bool = False, stopped: Callable[[], bool] = lambda: False) -> JobStats:
    began = time.monotonic()

    def alive() -> None:
        if stopped():
            raise PackError(Status.CANCELLED, "cancelled")

    validate(request)
    options, progress = request.options, Throttle(on_progress)
    check(options.format)
    ship(spark)
    alive()
    manifest = scan(spark, list(request.inputs), options.recurse, request.output)
    count, size, last = manifest.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0)), F.max_by("archive_path", "ordinal")).first()
    if not count:
        raise PackError(Status.INVALID_ARGUMENT, "no input files")
    archives.check_format(options.format, count)
    if os.path.exists(request.output) and not options.overwrite:
        raise PackError(Status.INVALID_ARGUMENT, f"{request.output} exists")
    log.info("packing %d files into %s", count, request.output)
    progress.update(total_files=count, total_bytes=size)
    alive()
    # deflate runs once: its result is written to the shared folder and read for sizes and again for bytes
    done = Counters(spark)
    source = compress_files(plan(manifest, options.block_bytes or MIB), options.level, engine.io_threads, done.files, done.read, done.written)
    made = watched(lambda: Kept(source, "pack-blocks"), lambda: done.show(progress, count, size))
    alive()
    meta = made.df.select("file_id", "block_index", "crc32", "uncompressed", "compressed")
    files = Kept(assemble(meta).join(manifest.select("file_id", "ordinal", "archive_path", "mtime"), "file_id"), "pack-files")
    rows = (archives.zip_rows if options.format == Format.ZIP else archives.gzip_rows)(files.df, made.df)
    alive()
    archives.write(rows, request.output, options.overwrite)
    kind = route(F.col("uncompressed"), options.algorithm, engine.enable_gpu and gpu_available, options.gpu_threshold_bytes)
    total = job_stats(files.df.withColumn("route", kind)).first().asDict()
    made.drop()
    files.drop()
    stats = JobStats(**total, elapsed_ms=int(1000 * (time.monotonic() - began)), archive_bytes=os.path.getsize(request.output))
    progress.update(processed_files=stats.files_processed, processed_bytes=stats.input_bytes, output_bytes=stats.output_bytes, current_file=last)
    progress.flush()
    log.info("packed %d bytes into %d in %d ms", stats.input_bytes, stats.archive_bytes, stats.elapsed_ms)
    return stats
