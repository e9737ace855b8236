"""Layout of ZIP and gzip archives as expressions over metadata: offsets, Zip64 and header bytes (as hex)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import LIMIT16, LIMIT32, dos_date, dos_time, gzip_isize, gzip_mtime, le_hex, name_bytes, utf8_flag
from .assemble import before

# Signatures and sizes of the formats.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
END64, LOCATOR64 = 0x06064B50, 0x07064B50
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
METHOD = 8
VERSION, VERSION64 = 20, 45
EXTRA64 = 1


def offsets(files: DataFrame, limit: int = LIMIT32, bucket: int = 1 << 17) -> DataFrame:
    """files(ordinal, name, compressed, uncompressed) with lfh_offset and zip64.

    A file's Zip64 header depends on its offset, and that on the headers before it. Flags by size give offsets that are
    right up to the first offset at the limit; all after it stay above the limit, so a second pass is exact.
    """
    by_size = (F.col("compressed") >= limit) | (F.col("uncompressed") >= limit)
    length = lambda flag: LOCAL_SIZE + name_bytes(F.col("name")) + F.when(F.col(flag), 20).otherwise(0) + F.col("compressed")
    first = before(files.withColumn("_by_size", by_size), length("_by_size"), "ordinal", "_offset", bucket)
    flagged = first.withColumn("zip64", F.col("_by_size") | (F.col("_offset") >= limit))
    return before(flagged, length("zip64"), "ordinal", "lfh_offset", bucket).drop("_by_size", "_offset")


def local_size() -> Column:
    return LOCAL_SIZE + name_bytes(F.col("name")) + F.when(F.col("zip64"), 20).otherwise(0)


def extra_fields(limit: int = LIMIT32) -> Column:
    """How many of the central entry's sizes and offset overflow."""
    return sum((F.when(F.col(c) >= limit, 1).otherwise(0) for c in ("uncompressed", "compressed", "lfh_offset")), F.lit(0))


def central_size(limit: int = LIMIT32) -> Column:
    n = extra_fields(limit)
    return CENTRAL_SIZE + name_bytes(F.col("name")) + F.when(n > 0, 4 + 8 * n).otherwise(0)


def directory(entries: DataFrame, limit: int = LIMIT32, entry_limit: int = LIMIT16) -> DataFrame:
    """One row: entries, cd_offset, cd_size, zip64 of the archive. entries come from offsets()."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = entries.agg(F.count("*").alias("entries"), total(local_size() + F.col("compressed")).alias("cd_offset"), total(central_size(limit)).alias("cd_size"), F.coalesce(F.max("zip64"), F.lit(False)).alias("_any"))
    return sums.select("entries", "cd_offset", "cd_size", (F.col("_any") | (F.col("entries") >= entry_limit) | (F.col("cd_size") >= limit) | (F.col("cd_offset") >= limit)).alias("zip64"))


def _version(flag: Column) -> Column:
    return F.when(flag, VERSION64).otherwise(VERSION)


def _capped(c: str, flag: Column, limit: int = LIMIT32) -> Column:
    return F.when(flag, F.lit(limit)).otherwise(F.col(c))


def local_header() -> Column:
    """Hex of the local header; columns name, mtime, crc32, compressed, uncompressed, zip64."""
    on = F.col("zip64")
    extra = F.when(on, F.concat(le_hex(EXTRA64, 2), le_hex(16, 2), le_hex(F.col("uncompressed"), 8), le_hex(F.col("compressed"), 8))).otherwise("")
    return F.concat(
        le_hex(LOCAL, 4), le_hex(_version(on), 2), le_hex(utf8_flag(F.col("name")), 2), le_hex(METHOD, 2), le_hex(dos_time(F.col("mtime")), 2), le_hex(dos_date(F.col("mtime")), 2),
        le_hex(F.col("crc32"), 4), le_hex(_capped("compressed", on), 4), le_hex(_capped("uncompressed", on), 4), le_hex(name_bytes(F.col("name")), 2), le_hex(F.when(on, 20).otherwise(0), 2),
        F.hex(F.encode("name", "UTF-8")), extra,
    )


def central_header(limit: int = LIMIT32) -> Column:
    """Hex of the central entry. Only fields that overflow are replaced and written to the extra field."""
    over = {c: F.col(c) >= limit for c in ("uncompressed", "compressed", "lfh_offset")}
    n = extra_fields(limit)
    extra = F.when(n > 0, F.concat(le_hex(EXTRA64, 2), le_hex(8 * n, 2), *[F.when(o, le_hex(F.col(c), 8)).otherwise("") for c, o in over.items()])).otherwise("")
    version = _version(F.col("zip64"))
    return F.concat(
        le_hex(CENTRAL, 4), le_hex(version, 2), le_hex(version, 2), le_hex(utf8_flag(F.col("name")), 2), le_hex(METHOD, 2), le_hex(dos_time(F.col("mtime")), 2), le_hex(dos_date(F.col("mtime")), 2),
        le_hex(F.col("crc32"), 4), le_hex(_capped("compressed", over["compressed"]), 4), le_hex(_capped("uncompressed", over["uncompressed"]), 4),
        le_hex(name_bytes(F.col("name")), 2), le_hex(F.when(n > 0, 4 + 8 * n).otherwise(0), 2), le_hex(0, 2), le_hex(0, 2), le_hex(0, 2), le_hex(0, 4), le_hex(_capped("lfh_offset", over["lfh_offset"]), 4),
        F.hex(F.encode("name", "UTF-8")), extra,
    )


def end_records() -> Column:
    """Hex of the archive's end; columns entries, cd_offset, cd_size, zip64."""
    n, offset, size, on = F.col("entries"), F.col("cd_offset"), F.col("cd_size"), F.col("zip64")
    wide = F.concat(
        le_hex(END64, 4), le_hex(END64_SIZE - 12, 8), le_hex(VERSION64, 2), le_hex(VERSION64, 2), le_hex(0, 4), le_hex(0, 4), le_hex(n, 8), le_hex(n, 8), le_hex(size, 8), le_hex(offset, 8),
        le_hex(LOCATOR64, 4), le_hex(0, 4), le_hex(offset + size, 8), le_hex(1, 4),
    )
    low = lambda c, most: F.when(on, F.least(c, F.lit(most).cast("long"))).otherwise(c)
    return F.concat(F.when(on, wide).otherwise(""), le_hex(END, 4), le_hex(0, 2), le_hex(0, 2), le_hex(low(n, LIMIT16), 2), le_hex(low(n, LIMIT16), 2), le_hex(low(size, LIMIT32), 4), le_hex(low(offset, LIMIT32), 4), le_hex(0, 2))


def gzip_header(seconds: Column) -> Column:
    return F.concat(F.lit("1F8B0800"), le_hex(gzip_mtime(seconds), 4), F.lit("00FF"))


def gzip_trailer(crc: Column, size: Column) -> Column:
    return F.concat(le_hex(crc, 4), le_hex(gzip_isize(size), 4))
