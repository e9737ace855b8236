"""Fields of archive headers as expressions: little-endian hex, DOS and gzip times, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT32 = 0xFFFFFFFF
LIMIT16 = 0xFFFF


def le_hex(x: Column | int, n: int) -> Column:
    """n bytes of a number, lowest first, as upper-case hex."""
    x = (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(n)])


def dos_time(t: Column) -> Column:
    """Times before 1980 are its start."""
    on = (F.hour(t) * 2048 + F.minute(t) * 32 + F.floor(F.second(t) / 2)).cast("int")
    return F.when(F.year(t) < 1980, F.lit(0)).otherwise(on)


def dos_date(t: Column) -> Column:
    """Years wrap after 2107."""
    on = ((F.year(t) - 1980).bitwiseAND(F.lit(127)) * 512 + F.month(t) * 32 + F.day(t)).cast("int")
    return F.when(F.year(t) < 1980, F.lit(33)).otherwise(on)


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, taken as UTC, rounded down."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", t).cast("timestamp_ntz"))


def gzip_mtime(seconds: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), seconds.cast("long")).bitwiseAND(F.lit(LIMIT32).cast("long"))


def gzip_isize(n: Column) -> Column:
    return F.pmod(n.cast("long"), F.lit(1 << 32))


def path_below(path: Column, root: Column) -> Column:
    """A file's path relative to the parent of the root it was found in, or to the root itself where that has none."""
    own = F.regexp_replace(root, "/+$", "")
    base = F.when(F.contains(own, F.lit("/")), F.regexp_extract(own, "^(.*)/[^/]*$", 1)).otherwise(own)
    return F.substring(path, F.char_length(base) + 2, F.char_length(path))


def name_in_archive(path: Column) -> Column:
    """Without leading slashes or backslashes."""
    return F.regexp_replace(path, r"^[/\\]+", "")


def name_bytes(name: Column) -> Column:
    return F.octet_length(F.encode(name, "UTF-8")).cast("long")


def utf8_flag(name: Column) -> Column:
    """Bit 11 where the name is not plain ASCII."""
    return F.when(name_bytes(name) != F.length(name), F.lit(0x0800)).otherwise(F.lit(0))


def parse_size(x: Column) -> Column:
    """Bytes of '123', '4K', '5m' or '6G'; null for anything else."""
    unit = F.upper(F.regexp_extract(x, r"^[0-9]+([KkMmGg]?)$", 1))
    number = F.regexp_extract(x, r"^([0-9]+)[KkMmGg]?$", 1)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("long")
    return F.when(number != "", F.try_multiply(number.try_cast("long"), factor))
