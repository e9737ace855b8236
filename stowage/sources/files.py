"""Files of a file system that the driver and all executors see: manifest and blocks.

Spark's binaryFile source drops empty files and reads a whole file into a row; here any range of a file is one block, so a
large file is spread over tasks. Directories are listed on executors, one level of all trees a step, and the manifest is a
table: no file or block is an object on the driver.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.wire import path_below
from ..model import MIB, PackError, Status
from ..operators.assemble import numbered
from ..operators.blocks import split
from ..shared import keep

#: Bytes that one task reads, if blocks are smaller, and bytes of blocks that travel at once.
TASK_BYTES, BATCH_BYTES = 64 * MIB, 64 * MIB
#: Directories that one task lists.
TASK_DIRS = 64
LISTED = "input int, root string, path string, is_dir boolean, size_bytes long, mtime timestamp_ntz"


def _found(number: int, root: str, path: str, is_dir: bool, s: os.stat_result | None) -> tuple:
    mtime = datetime.fromtimestamp(s.st_mtime, UTC).replace(tzinfo=None) if s else None
    return (number, root, path, is_dir, s.st_size if s else 0, mtime)


def _list(number: int, root: str, path: str, skip: str | None) -> Iterator[tuple]:
    """A directory's regular files and subdirectories. One that may not be read has none; links to directories are not followed."""
    try:
        entries = list(os.scandir(path))
    except PermissionError:
        return
    except OSError as e:
        raise PackError(Status.IO, f"{path}: {e}") from e
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            yield _found(number, root, e.path, True, None)
        elif e.is_file() and os.path.realpath(e.path) != skip:
            try:
                yield _found(number, root, e.path, False, os.stat(e.path))
            except OSError as error:
                raise PackError(Status.IO, f"{e.path}: {error}") from error


def _roots(inputs: list[str], skip: str | None) -> Iterator[tuple]:
    """The inputs themselves."""
    for number, root in enumerate(inputs):
        try:
            s = os.stat(root)
        except FileNotFoundError as e:
            raise PackError(Status.NOT_FOUND, root) from e
        except OSError as e:
            raise PackError(Status.IO, f"{root}: {e}") from e
        if stat.S_ISREG(s.st_mode):
            if os.path.realpath(root) != skip:
                yield _found(number, root, root, False, s)
        elif stat.S_ISDIR(s.st_mode):
            yield _found(number, root, root, True, None)
        else:
            raise PackError(Status.INVALID_ARGUMENT, f"{root} is neither a file nor a directory")


def scan(spark: SparkSession, inputs: list[str], recurse: bool = True, exclude: str | None = None) -> DataFrame:
    """The manifest (as model.MANIFEST) of the inputs' regular files: inputs in the order given, a directory's files by their paths' components.

    Ids count from 1 in the order of the walk: by input, directory and name. An input given twice is there twice. exclude:
    the output, if it lies in an input.
    """
    skip = os.path.realpath(exclude) if exclude else None
    columns = [c.split()[0] for c in LISTED.split(", ")]

    def listed(batches):
        for batch in batches:
            rows = [x for number, root, path in zip(*(c.to_pylist() for c in batch.columns)) for x in _list(number, root, path, skip)]
            for s in range(0, len(rows), 10_000):
                part = list(zip(*rows[s : s + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(part, (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us")))], names=columns)

    level = spark.createDataFrame(list(_roots(inputs, skip)), LISTED)
    files = level.where("not is_dir")
    first = True
    while not (dirs := level.where("is_dir").select("input", "root", "path")).isEmpty():
        if not first and not recurse:
            break
        parts = max(1, -(-dirs.count() // TASK_DIRS))
        level, first = keep(dirs.repartition(parts).mapInArrow(listed, LISTED), "listing"), False
        files = files.union(level.where("not is_dir"))
    parts = F.split("path", "/")
    keyed = files.withColumns({"parts": parts, "folder": F.slice(parts, 1, F.size(parts) - 1), "name": F.element_at(parts, -1)})
    walked = numbered(keyed, ["input", "folder", "name"], "walk")
    placed = numbered(walked.drop("folder", "name"), ["input", "parts", "walk"], "ordinal")
    return keep(placed.select((F.col("walk") + 1).alias("file_id"), "ordinal", F.col("path").alias("source"), _archive_path().alias("archive_path"), "size_bytes", "mtime"), "manifest")


def _archive_path() -> Column:
    return F.when(F.col("path") == F.col("root"), F.element_at(F.split("path", "/"), -1)).otherwise(path_below(F.col("path"), F.col("root")))


def read_range(path: str, offset: int, size: int) -> bytes:
    """A block's bytes. Sizes are those of the scan: a file that has shrunk since is an error."""
    if not size:
        return b""
    try:
        with open(path, "rb") as f:
            f.seek(offset)
            data = f.read(size)
    except OSError as e:
        raise PackError(Status.IO, f"{path}: {e}") from e
    if len(data) != size:
        raise PackError(Status.IO, f"{path}: {len(data)} of {size} bytes at {offset}")
    return data


def read_ahead(ranges: list[tuple[str, int, int]], threads: int) -> Iterator[bytes]:
    """The ranges' bytes in order, `threads` of them read at a time; no more than that many are held."""
    with ThreadPoolExecutor(max(1, threads)) as pool:
        left, waiting = iter(ranges), deque()
        for r in left:
            waiting.append(pool.submit(read_range, *r))
            if len(waiting) >= max(1, threads):
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def plan(manifest: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block of the manifest's files (file_id, source, block_index, logical_offset, used_bytes, is_last), dealt so
    that a task reads about TASK_BYTES, in the order of the archive."""
    blocks = split(manifest.select("file_id", "ordinal", "source", "size_bytes"), block_bytes)
    total = manifest.agg(F.sum("size_bytes"), F.count("*")).first()
    tasks = max(1, -(-(total[0] or 0) // TASK_BYTES), -(-total[1] // 10_000))
    return blocks.repartitionByRange(tasks, "ordinal", "block_index").sortWithinPartitions("ordinal", "block_index").drop("size_bytes", "ordinal")


def blocks(manifest: DataFrame, block_bytes: int, io_threads: int = 1) -> DataFrame:
    """plan() with the blocks' bytes in `payload`."""
    names = ["file_id", "block_index", "is_last", "logical_offset", "used_bytes"]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            sizes = col["used_bytes"]
            parts = read_ahead(list(zip(col["source"], col["logical_offset"], sizes)), io_threads)
            s = 0
            while s < len(sizes):
                e, held = s, []
                while e < len(sizes) and (e == s or sum(map(len, held)) + sizes[e] <= BATCH_BYTES):
                    held.append(next(parts))
                    e += 1
                yield pa.RecordBatch.from_arrays([*(pa.array(col[n][s:e], k) for n, k in zip(names, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))), pa.array(held, pa.binary())], names=[*names, "payload"])
                s = e

    return plan(manifest, block_bytes).mapInArrow(run, "file_id long, block_index int, is_last boolean, logical_offset long, used_bytes long, payload binary")


class FilesReader(DataSourceReader):
    """Reads manifests: a partition an input, listed where it is read."""

    def __init__(self, options: dict):
        self.inputs, self.recurse = json.loads(options["inputs"]), options.get("recurse", "true") == "true"
        self.skip = os.path.realpath(options["exclude"]) if "exclude" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, root)) for k, root in enumerate(self.inputs)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        _, root = partition.value
        todo, top = list(_roots([root], self.skip)), True
        while todo:
            number, base, path, is_dir, size, mtime = todo.pop()
            if not is_dir:
                yield (base, path, size, mtime)
            elif top or self.recurse:
                todo += _list(number, base, path, self.skip)
                top = False


class PackFiles(DataSource):
    """spark.read.format('packfiles'): the files of inputs (a JSON list) with options recurse and exclude."""

    @classmethod
    def name(cls) -> str:
        return "packfiles"

    def schema(self):
        return "root string, path string, size_bytes long, mtime timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackFiles)

