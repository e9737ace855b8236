"""Raw deflate of blocks, and inflate to verify it.

The blocks of a file are one deflate stream: all but the last end at a byte boundary without closing the stream, so a
file's compressed blocks can be concatenated.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..model import ZLIB_LEVEL, Format, Level, PackError, Status


def deflate_bytes(data: bytes, is_last: bool, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 8)
    return z.compress(data) + z.flush(zlib.Z_FINISH if is_last else zlib.Z_SYNC_FLUSH)


def inflate_bytes(data: bytes) -> bytes:
    z = zlib.decompressobj(-15)
    out = z.decompress(data) + z.flush()
    if not z.eof or z.unused_data:
        raise ValueError("not one whole deflate stream")
    return out


def deflate_batch(parts: list[bytes], out: list, level: Level = Level.BALANCED, ends: bool = True) -> None:
    """Blocks of one file that follow each other, into a list of as many places. ends: the last is the file's last."""
    if len(parts) != len(out):
        raise PackError(Status.INVALID_ARGUMENT, f"{len(parts)} blocks for {len(out)} places")
    for i, data in enumerate(parts):
        out[i] = deflate_bytes(data, ends and i + 1 == len(parts), ZLIB_LEVEL[level])


def deflate_runs(file_id: list, is_last: list[bool], parts: list[bytes], level: Level) -> list[bytes]:
    """Blocks of several files, those of a file one after the other, as one batch a file."""
    out: list = [None] * len(parts)
    s = 0
    while s < len(parts):
        e = s + 1
        while e < len(parts) and file_id[e] == file_id[s] and not is_last[e - 1]:
            e += 1
        done: list = [None] * (e - s)
        deflate_batch(parts[s:e], done, level, is_last[e - 1])
        out[s:e] = done
        s = e
    return out


def deflated(blocks: DataFrame, level: Level = Level.BALANCED) -> DataFrame:
    """blocks(file_id, block_index, is_last, payload), a file's in order within a partition: file_id, block_index, crc32, uncompressed, compressed and bytes, a batch a file."""
    source = blocks.select("file_id", "block_index", "is_last", "payload")

    def run(batches):
        for b in batches:
            ids, last = b.column(0).to_pylist(), b.column(2).to_pylist()
            yield packed(b.column(0), b.column(1), ids, last, b.column(3).to_pylist(), level)

    return source.mapInArrow(run, f"file_id {source.schema['file_id'].dataType.simpleString()}, block_index {source.schema['block_index'].dataType.simpleString()}, {MADE}")


#: What deflating a block gives.
MADE = "crc32 long, uncompressed long, compressed long, bytes binary"


def packed(file_id: pa.Array, block_index: pa.Array, ids: list, last: list[bool], parts: list[bytes], level: Level) -> pa.RecordBatch:
    made = deflate_runs(ids, last, parts, level)
    numbers = [[zlib.crc32(p) for p in parts], [len(p) for p in parts], [len(m) for m in made]]
    return pa.RecordBatch.from_arrays([file_id, block_index, *(pa.array(x, pa.int64()) for x in numbers), pa.array(made, pa.binary())], names=["file_id", "block_index", "crc32", "uncompressed", "compressed", "bytes"])


def check(format: Format) -> None:
    if format not in (Format.ZIP, Format.GZIP):
        raise PackError(Status.UNSUPPORTED, f"no codec for {format.name}")


def deflate(payload: Column, is_last: Column, level: Level = Level.BALANCED) -> Column:
    number = ZLIB_LEVEL[level]

    @F.pandas_udf(BinaryType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, last in parts:
            yield pd.Series([None if d is None else deflate_bytes(bytes(d), bool(x), number) for d, x in zip(data, last)], dtype=object)

    return run(payload, is_last)


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else inflate_bytes(bytes(d)) for d in data], dtype=object)


@F.pandas_udf(BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else gzip.decompress(bytes(d)) for d in data], dtype=object)
