"""Archives as rows (offset, bytes) and a sink that writes them in place.

All offsets are known from metadata, so each task writes its rows where they belong in one file and nothing passes
through the driver; a task that runs twice writes the same bytes to the same places. The file gets its name only when
all tasks have ended. The output must lie on a file system that the driver and all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.wire import epoch_seconds, name_bytes, name_in_archive
from ..model import Format, PackError, Status
from ..operators import layout
from ..shared import keep


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class InPlaceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, temporary: str):
        self.path, self.temporary = path, temporary

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        total = 0
        with open(self.temporary, "r+b") as f:
            for batch in iterator:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    f.seek(at)
                    total += f.write(data.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        return Written(total)

    def commit(self, messages) -> None:
        os.replace(self.temporary, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class PackArchive(DataSource):
    """df(offset long, bytes binary).write.format('packarchive').option('path', file)."""

    @classmethod
    def name(cls) -> str:
        return "packarchive"

    def writer(self, schema, overwrite: bool):
        path = self.options["path"]
        temporary = os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.partial")
        return InPlaceWriter(path, temporary)


def open_output(path: str, overwrite: bool) -> None:
    """Fails if the file is there and may not be replaced; makes its directory."""
    if os.path.isdir(path):
        raise PackError(Status.IO, f"{path} is a directory")
    if os.path.exists(path) and not overwrite:
        raise PackError(Status.INVALID_ARGUMENT, f"{path} exists")
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(os.path.join(os.path.dirname(path) or ".", f".{os.path.basename(path)}.partial"), "wb"):
            pass
    except OSError as e:
        raise PackError(Status.IO, f"{path}: {e}") from e


def check_format(format: Format, files: int) -> None:
    if format not in (Format.ZIP, Format.GZIP):
        raise PackError(Status.UNSUPPORTED, f"no writer for {format.name}")
    if format == Format.GZIP and files != 1:
        raise PackError(Status.FORMAT_ERROR, "gzip holds one file")


def _placed(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of the blocks' bytes. Places come from the blocks' sizes; bytes are only joined to them."""
    own = F.sum("compressed").over(W.partitionBy("file_id").orderBy("block_index").rowsBetween(W.unboundedPreceding, 0)) - F.col("compressed")
    places = blocks.select("file_id", "block_index", "compressed").withColumn("_own", own).join(starts, "file_id").select("file_id", "block_index", (F.col("_start") + F.col("_own")).alias("offset"))
    return blocks.select("file_id", "block_index", "bytes").join(places, ["file_id", "block_index"]).select("offset", "bytes")


def zip_rows(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """files(file_id, ordinal, archive_path, mtime, file_crc32, uncompressed, compressed) and blocks(file_id, block_index, compressed, bytes) to (offset, bytes)."""
    entries = layout.offsets(files.select("file_id", "ordinal", name_in_archive(F.col("archive_path")).alias("name"), "mtime", F.col("file_crc32").alias("crc32"), "uncompressed", "compressed"))
    entries = entries.withColumn("name", F.when(name_bytes(F.col("name")) <= 65535, F.col("name")).otherwise(F.raise_error(F.lit("FORMAT_ERROR: a name of more than 65535 bytes"))))
    entries = keep(entries, "zip-entries")  # read by all parts of the archive
    heads = entries.select(F.col("lfh_offset").alias("offset"), F.unhex(layout.local_header()).alias("bytes"))
    data = _placed(blocks, entries.select("file_id", (F.col("lfh_offset") + layout.local_size()).alias("_start")))
    total = layout.directory(entries)
    central = layout.before(entries, layout.central_size(), "ordinal", "_at")
    central = central.select((total.select("cd_offset").scalar() + F.col("_at")).alias("offset"), F.unhex(layout.central_header()).alias("bytes"))
    end = total.select((F.col("cd_offset") + F.col("cd_size")).alias("offset"), F.unhex(layout.end_records()).alias("bytes"))
    return heads.union(data).union(central).union(end)


def gzip_rows(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same for the one file of a gzip stream."""
    head = files.select(F.lit(0).cast("long").alias("offset"), F.unhex(layout.gzip_header(epoch_seconds(F.col("mtime")))).alias("bytes"))
    data = _placed(blocks, files.select("file_id", F.lit(10).cast("long").alias("_start")))
    end = files.select((F.col("compressed") + 10).alias("offset"), F.unhex(layout.gzip_trailer(F.col("file_crc32"), F.col("uncompressed"))).alias("bytes"))
    return head.union(data).union(end)


def write(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(PackArchive)
    open_output(path, overwrite)
    rows.write.format("packarchive").option("path", path).mode("append").save()
