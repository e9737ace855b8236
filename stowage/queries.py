"""One query per operator over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.crc import combine_col
from .functions.wire import dos_date, dos_time, epoch_seconds, gzip_isize, gzip_mtime, le_hex, name_in_archive, parse_size, path_below
from .model import EXTENSION, Algorithm, Format, JobOptions, Level, is_archive
from .operators import layout
from .operators.assemble import assemble, before, job_stats, numbered, progress, ratio, saved_percent
from .operators.blocks import block_count, read, route, split
from .operators.codec import deflate, deflated, gunzip, inflate
from .plans.pack import compressed
from .shared import Kept, discard, shared_dir
from .sources import archives
from .sources.tables import conversations, documents, ordered, table

BLOCK = THRESHOLD = 4096
#: Scaled limits, so that small tables cross them.
LIMIT, ENTRY_LIMIT = 1 << 20, 500

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FILES = """files as (
  select doc_id as file_id, coalesce(source, '') as source, coalesce(lang, '') as lang, doc_id || '.txt' as file_name,
    coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' as archive_path, encode(coalesce(text, '')) as payload,
    octet_length(encode(coalesce(text, '')))::bigint as size_bytes,
    (row_number() over (order by coalesce(source, ''), coalesce(lang, ''), doc_id || '.txt', doc_id) - 1)::bigint as ordinal
  from documents)"""
BLOCKS = f"""{FILES},
blocks as (
  select *, i::int as block_index, (i * {BLOCK})::bigint as logical_offset, least({BLOCK}, size_bytes - i * {BLOCK})::bigint as used_bytes, i = n - 1 as is_last
  from (select *, greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK}) as n, unnest(range(greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK}))) as i from files))"""


def query(sql: str):
    """Registers a query and its SQL under the function's name without a trailing underscore."""

    def add(f):
        QUERIES[f.__name__.rstrip("_")], ORACLE_SQL[f.__name__.rstrip("_")] = f, sql
        return f

    return add


def sql_le(x: str, n: int) -> str:
    return "(" + " || ".join(f"printf('%02X', (({x})::bigint >> {8 * k}) & 255)" for k in range(n)) + ")"


# Scans


@query(f"with {FILES} select file_id, archive_path, size_bytes from files")
def scan_manifest(spark, d):
    return documents(spark, d).select("file_id", "archive_path", "size_bytes")


@query("""
select page_id, regexp_replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '[?#].*$', '') as source_path,
  array_to_string(string_split(regexp_replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '[?#].*$', ''), '/')[2:], '/') as archive_path
from pages""")
def archive_path(spark, d):
    """Paths below a root that has a parent are relative to it: the parent here is the host."""
    source = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", ""), "[?#].*$", "")
    root = F.concat(F.regexp_extract("source_path", "^([^/]*)", 1), F.lit("/root"))
    return table(spark, d, "pages").select("page_id", source.alias("source_path")).withColumn("archive_path", path_below(F.col("source_path"), root))


@query(f"with {FILES} select ordinal, archive_path from files")
def scan_order(spark, d):
    return ordered(documents(spark, d)).select("ordinal", "archive_path")


@query("select page_id, (row_number() over (order by regexp_extract(coalesce(url, ''), '//([^/]*)', 1), page_id))::bigint as file_id from pages")
def file_ids(spark, d):
    """Ids from 1 in walk order (host, then page), before any sort by path."""
    walked = table(spark, d, "pages").select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), "//([^/]*)", 1).alias("host"))
    return numbered(walked, ["host", "page_id"], "n").select("page_id", (F.col("n") + 1).alias("file_id"))


@query(f"with {BLOCKS} select file_id, block_index, logical_offset, used_bytes, is_last from blocks")
def block_plan(spark, d):
    return split(documents(spark, d).select("file_id", "size_bytes"), BLOCK).drop("size_bytes")


@query(f"with {BLOCKS} select file_id, block_index, md5(unhex(substr(hex(payload), (2 * logical_offset + 1)::bigint, 2 * used_bytes))) as digest from blocks")
def block_bytes(spark, d):
    blocks = read(split(documents(spark, d, payload=True).select("file_id", "size_bytes", "payload"), BLOCK))
    return blocks.select("file_id", "block_index", F.md5("payload").alias("digest"))


@query(f"with {FILES} select count(*)::bigint as total_files, sum(size_bytes)::bigint as total_bytes from files")
def scan_totals(spark, d):
    return documents(spark, d).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


# Routing


@query(f"with {FILES} select file_id, size_bytes, case when size_bytes >= {THRESHOLD} then 'Gpu' else 'Cpu' end as route from files")
def route_auto(spark, d):
    return documents(spark, d).select("file_id", "size_bytes", route(F.col("size_bytes"), Algorithm.AUTO, True, THRESHOLD).alias("route"))


@query("""
select o_orderkey, a::int as algorithm, g as gpu_available,
  case when not g then 'Cpu' when a = 1 then 'Cpu' when a in (2, 3) then 'Gpu' when floor(o_totalprice)::bigint >= 100000 then 'Gpu' else 'Cpu' end as route
from orders, (select unnest(range(6)) as a), (select unnest([true, false]) as g)""")
def route_matrix(spark, d):
    """Every algorithm, with and without a device, at every order's size."""
    sizes = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    cases = sizes.withColumn("algorithm", F.explode(F.array(*[F.lit(int(a)) for a in Algorithm]))).withColumn("gpu_available", F.explode(F.array(F.lit(True), F.lit(False))))
    return cases.select("o_orderkey", "algorithm", "gpu_available", route(F.col("size"), F.col("algorithm"), F.col("gpu_available"), 100000).alias("route"))


@query(f"""with {FILES} select case when size_bytes >= {THRESHOLD} then 'Gpu' else 'Cpu' end as route, sum(greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK}))::bigint as blocks from files group by 1""")
def route_tally(spark, d):
    files = documents(spark, d).select(route(F.col("size_bytes"), Algorithm.AUTO, True, THRESHOLD).alias("route"), block_count(F.col("size_bytes"), BLOCK).alias("n"))
    return files.groupBy("route").agg(F.sum("n").alias("blocks"))


@query("select * from (values ('ZIP', '.zip', true), ('GZIP', '.gz', false), ('ZSTD', '.zst', false)) t(format, extension, is_archive)")
def format_scalars(spark, d):
    return spark.createDataFrame([(f.name, EXTENSION[f], is_archive(f)) for f in Format], "format string, extension string, is_archive boolean")


# Codec and checksums


@query(f"with {FILES} select file_id, md5(payload) as digest from files")
def deflate_roundtrip(spark, d):
    """Each file as one block."""
    files = documents(spark, d, payload=True).select("file_id", "payload")
    return files.select("file_id", F.md5(inflate(deflate(F.col("payload"), F.lit(True)))).alias("digest"))


def _joined(blocks: DataFrame, key: str = "file_id") -> DataFrame:
    """The compressed blocks of each file, in order, as one payload."""
    return blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block_index", "bytes"))).alias("_b")).select(key, F.unhex(F.array_join(F.transform("_b", lambda b: F.hex(b["bytes"])), "")).alias("bytes"))


def _compressed(spark, d, level=Level.BALANCED) -> DataFrame:
    blocks = read(split(documents(spark, d, payload=True).select("file_id", "size_bytes", "payload"), BLOCK))
    return blocks.withColumn("bytes", deflate(F.col("payload"), F.col("is_last"), level))


@query(f"with {FILES} select file_id, md5(payload) as digest from files")
def deflate_blocks_concat(spark, d):
    """Files of several blocks inflate as one stream."""
    return _joined(_compressed(spark, d).select("file_id", "block_index", "bytes")).select("file_id", F.md5(inflate(F.col("bytes"))).alias("digest"))


@query("select item_id, l as level, md5(encode(coalesce(text, ''))) as digest from benchmark, (select unnest(['FAST', 'BALANCED', 'BEST']) as l)")
def level_roundtrip(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    each = [items.select("item_id", F.lit(level.name).alias("level"), F.md5(inflate(deflate(F.col("payload"), F.lit(True), level))).alias("digest")) for level in Level]
    return each[0].union(each[1]).union(each[2])


SQL_CRC = """tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def sql_crc(text: str) -> str:
    bytes_ = f"list_transform(range(length({text})), lambda j: ascii(substr({text}, (j + 1)::bigint, 1))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(t[((xor(c, b)) & 255) + 1], c >> 8)), 4294967295)"


@query(f"with {SQL_CRC} select n_nationkey, {sql_crc('n_name')}::bigint as crc32 from nation, tab")
def crc32_scalar(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.crc32(F.encode("n_name", "UTF-8")).alias("crc32"))


@query("select item_id, true as equal from benchmark")
def crc32_incremental(spark, d):
    """Chunks of 100 bytes folded from the left give the one-shot value."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")).withColumn("size_bytes", F.octet_length("payload").cast("long"))
    chunks = read(split(items, 100)).select("file_id", "block_index", F.crc32("payload").alias("crc32"), F.col("used_bytes").alias("uncompressed"), F.lit(0).cast("long").alias("compressed"))
    whole = items.select("file_id", F.crc32("payload").alias("whole"))
    return assemble(chunks).join(whole, "file_id").select(F.col("file_id").alias("item_id"), (F.col("file_crc32") == F.col("whole")).alias("equal"))


@query("select c_custkey, true as equal from customer")
def crc32_combine(spark, d):
    """The CRC of name and segment from the CRCs of both."""
    a, b = F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8")
    both = F.crc32(F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8"))
    return table(spark, d, "customer").select("c_custkey", (combine_col(F.crc32(a), F.crc32(b), F.octet_length(b).cast("long")) == both).alias("equal"))


@query("select conv_id, md5(encode(string_agg(coalesce(text, ''), '' order by turn))) as digest from conversations group by conv_id")
def batch_roundtrip(spark, d):
    """A batch is a file's blocks: a conversation's turns compress together and come back in order."""
    from pyspark.sql import Window as W

    turns = conversations(spark, d).withColumn("is_last", F.lead("block_index").over(W.partitionBy("file_id").orderBy("block_index")).isNull())
    return _joined(deflated(turns.repartition("file_id").sortWithinPartitions("file_id", "block_index"))).select(F.col("file_id").alias("conv_id"), F.md5(inflate(F.col("bytes"))).alias("digest"))


SIZES = ["1024", "1K", "1k", "1m", "2G", "1MiB", "", "K", "-1", "1.5K", "7g", "0", " 1K", "1K "]


@query(
    "select s as input, case when regexp_matches(s, '^[0-9]+[KkMmGg]?$') then regexp_extract(s, '^([0-9]+)', 1)::bigint * (case upper(regexp_extract(s, '([KkMmGg])$', 1)) when 'K' then 1024 when 'M' then 1048576 when 'G' then 1073741824 else 1 end)::bigint end as bytes from (select unnest(["
    + ", ".join(f"'{s}'" for s in SIZES)
    + "]) as s)"
)
def parse_size_(spark, d):
    return spark.createDataFrame([(s,) for s in SIZES], "input string").select("input", parse_size(F.col("input")).alias("bytes"))


@query("""select l_orderkey, l_linenumber, case when n > 0 then round(m / n, 9) end as ratio, case when n > 0 then round(100 - 100 * (m / n), 6) end as saved
from (select l_orderkey, l_linenumber, (floor(l_extendedprice) * (l_linenumber % 5))::double as n, floor(l_extendedprice * l_quantity / 50)::double as m from lineitem)""")
def ratio_report(spark, d):
    """Compressed over uncompressed bytes, and the per cent saved, only if there is input; prices stand in for sizes, so a fifth of them is 0 and some grow."""
    n, m = (F.floor("l_extendedprice") * (F.col("l_linenumber") % 5)).cast("double"), F.floor(F.col("l_extendedprice") * F.col("l_quantity") / 50).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(ratio(n, m), 9).alias("ratio"), F.round(saved_percent(n, m), 6).alias("saved"))


# Ordered aggregation


@query("select conv_id as file_id, to_json(list(turn order by turn)) as blocks from conversations group by conv_id")
def block_order(spark, d):
    return conversations(spark, d).groupBy("file_id").agg(F.to_json(F.sort_array(F.collect_list("block_index"))).alias("blocks"))


@query(f"with {FILES} select file_id, greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK})::int as blocks, size_bytes as uncompressed, size_bytes as compressed, true as crc_equal from files")
def assemble_files(spark, d):
    """Sizes, block counts and the combined CRC against the whole file's; stored bytes stand in for compressed ones."""
    files = documents(spark, d, payload=True).select("file_id", "size_bytes", "payload")
    blocks = read(split(files, BLOCK)).select("file_id", "block_index", F.crc32("payload").alias("crc32"), F.col("used_bytes").alias("uncompressed"), F.col("used_bytes").alias("compressed"))
    whole = files.select("file_id", F.crc32("payload").alias("whole"))
    return assemble(blocks).join(whole, "file_id").select("file_id", "blocks", "uncompressed", "compressed", (F.col("file_crc32") == F.col("whole")).alias("crc_equal"))


@query(f"with {BLOCKS} select (row_number() over (order by ordinal, block_index) - 1)::bigint as position, ordinal, block_index from blocks")
def file_order(spark, d):
    """Blocks leave in file order, whatever order they were made in."""
    files = ordered(documents(spark, d)).select("ordinal", "size_bytes")
    blocks = split(before(files, block_count(F.col("size_bytes"), BLOCK), "ordinal", "first"), BLOCK)
    return blocks.select((F.col("first") + F.col("block_index")).alias("position"), "ordinal", "block_index")


@query(f"""with {FILES} select count(*)::bigint as files_processed, 0::bigint as files_skipped, sum(size_bytes)::bigint as input_bytes,
  sum(case when size_bytes < {THRESHOLD} then n else 0 end)::bigint as cpu_blocks, sum(case when size_bytes >= {THRESHOLD} then n else 0 end)::bigint as gpu_blocks, true as output_sane
  from (select *, greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK}) as n from files)""")
def job_stats_(spark, d):
    sizes = _compressed(spark, d).groupBy("file_id").agg(F.sum("used_bytes").alias("uncompressed"), F.sum(F.octet_length("bytes")).alias("compressed"), F.count("*").alias("blocks"))
    stats = job_stats(sizes.withColumn("route", route(F.col("uncompressed"), Algorithm.AUTO, True, THRESHOLD)))
    return stats.select("files_processed", "files_skipped", "input_bytes", "cpu_blocks", "gpu_blocks", ((F.col("output_bytes") > 0) & (F.col("output_bytes") < F.col("input_bytes"))).alias("output_sane"))


@query(f"""with {FILES} select ordinal, (ordinal + 1)::bigint as processed_files, (sum(size_bytes) over (order by ordinal))::bigint as processed_bytes,
  (sum(size_bytes // 3 + 20) over (order by ordinal))::bigint as output_bytes, (count(*) over ())::bigint as total_files,
  (sum(size_bytes) over ())::bigint as total_bytes, round(100 * (sum(size_bytes) over (order by ordinal))::double / (sum(size_bytes) over ())::double, 6) as percent from files""")
def progress_running(spark, d):
    """A third of a file and 20 bytes stand in for its compressed size."""
    files = ordered(documents(spark, d)).select("ordinal", "size_bytes")
    return progress(files.withColumn("compressed", F.floor(F.col("size_bytes") / 3) + 20))


@query(f"""with {FILES} select file_id, size_bytes, greatest(1, (size_bytes + {BLOCK - 1}) // {BLOCK})::bigint as blocks, case when size_bytes >= {THRESHOLD} then 'Gpu' else 'Cpu' end as route, ordinal from files""")
def file_plan(spark, d):
    """Per file its place in the archive, blocks and route."""
    return ordered(documents(spark, d)).select("file_id", "size_bytes", block_count(F.col("size_bytes"), BLOCK).alias("blocks"), route(F.col("size_bytes"), Algorithm.AUTO, True, THRESHOLD).alias("route"), "ordinal")


# Layout


def _entries(spark, d, scale: int = 1) -> DataFrame:
    """Files with stored bytes standing in for compressed ones."""
    files = ordered(documents(spark, d)).select("ordinal", F.col("archive_path").alias("name"), (F.col("size_bytes") * scale).alias("uncompressed"))
    return files.withColumn("compressed", F.col("uncompressed"))


def sql_entries(scale: int = 1, limit: int = 0xFFFFFFFF) -> str:
    length = "30 + octet_length(encode(name)) + (case when {flag} then 20 else 0 end) + compressed"
    return f"""{FILES},
e0 as (select ordinal, archive_path as name, size_bytes * {scale} as uncompressed, size_bytes * {scale} as compressed from files),
e1 as (select *, coalesce(sum({length.format(flag=f'compressed >= {limit}')}) over (order by ordinal rows between unbounded preceding and 1 preceding), 0) as o from e0),
e2 as (select *, compressed >= {limit} or o >= {limit} as zip64 from e1),
entries as (select ordinal, name, compressed, uncompressed, zip64, coalesce(sum({length.format(flag='zip64')}) over (order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as lfh_offset from e2)"""


@query(f"with {sql_entries()} select ordinal, name, lfh_offset from entries")
def zip_offsets(spark, d):
    return layout.offsets(_entries(spark, d)).select("ordinal", "name", "lfh_offset")


@query(f"with {sql_entries(limit=LIMIT)} select ordinal, zip64, lfh_offset from entries")
def zip64_flags(spark, d):
    """With a limit scaled down, so that offsets cross it."""
    return layout.offsets(_entries(spark, d), LIMIT).select("ordinal", "zip64", "lfh_offset")


CD = """dir as (select count(*)::bigint as entries, coalesce(sum(30 + octet_length(encode(name)) + (case when zip64 then 20 else 0 end) + compressed), 0)::bigint as cd_offset,
  coalesce(sum(46 + octet_length(encode(name)) + (case when k > 0 then 4 + 8 * k else 0 end)), 0)::bigint as cd_size, coalesce(bool_or(zip64), false) as any64
  from (select *, (uncompressed >= {limit})::int + (compressed >= {limit})::int + (lfh_offset >= {limit})::int as k from entries))"""


@query(f"with {sql_entries()}, {CD.format(limit=0xFFFFFFFF)} select entries, cd_offset, cd_size from dir")
def cd_layout(spark, d):
    return layout.directory(layout.offsets(_entries(spark, d))).select("entries", "cd_offset", "cd_size")


@query(
    "select limit_bytes, limit_entries, zip64 from ("
    + " union all ".join(
        f"(with {sql_entries(limit=b)}, {CD.format(limit=b)} select {b}::bigint as limit_bytes, {n}::bigint as limit_entries, any64 or entries >= {n} or cd_size >= {b} or cd_offset >= {b} as zip64 from dir)" for b, n in ((0xFFFFFFFF, 0xFFFF), (0xFFFFFFFF, ENTRY_LIMIT), (LIMIT, 0xFFFF))
    )
    + ")"
)
def archive_zip64(spark, d):
    entries = _entries(spark, d)
    each = [layout.directory(layout.offsets(entries, b), b, n).select(F.lit(b).cast("long").alias("limit_bytes"), F.lit(n).cast("long").alias("limit_entries"), "zip64") for b, n in ((0xFFFFFFFF, 0xFFFF), (0xFFFFFFFF, ENTRY_LIMIT), (LIMIT, 0xFFFF))]
    return each[0].union(each[1]).union(each[2])


# Header fields


@query(f"select o_orderkey, {sql_le('o_orderkey', 2)} as le16, {sql_le('o_orderkey * 65537', 4)} as le32, {sql_le('o_orderkey * 4294967299', 8)} as le64 from orders")
def le_encode(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", le_hex(k, 2).alias("le16"), le_hex(k * 65537, 4).alias("le32"), le_hex(k * 4294967299, 8).alias("le64"))


SQL_DOS = """(case when year({t}) < 1980 then 0 else hour({t}) * 2048 + minute({t}) * 32 + second({t}) // 2 end)::int"""
SQL_DATE = """(case when year({t}) < 1980 then 33 else ((year({t}) - 1980) & 127) * 512 + month({t}) * 32 + day({t}) end)::int"""


@query(f"select event_id, {SQL_DOS.format(t='ts')} as dos_time, {SQL_DATE.format(t='ts')} as dos_date from events")
def dos_time_(spark, d):
    return table(spark, d, "events").select("event_id", dos_time(F.col("ts")).alias("dos_time"), dos_date(F.col("ts")).alias("dos_date"))


@query("""select page_id, regexp_replace(('/\\' || '//')[:(page_id % 5)::int] || regexp_replace(coalesce(url, ''), '^[a-z]+:', ''), '^[/\\\\]+', '') as name from pages""")
def sanitise_name(spark, d):
    prefix = F.substring(F.lit("/\\//"), F.lit(1), (F.col("page_id") % 5).cast("int"))
    return table(spark, d, "pages").select("page_id", name_in_archive(F.concat(prefix, F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+:", ""))).alias("name"))


@query("select event_id, (greatest(0, s) & 4294967295)::bigint as mtime from (select event_id, floor(epoch(ts))::bigint - (event_id % 3) * 2000000000 as s from events)")
def gzip_mtime_(spark, d):
    seconds = epoch_seconds(F.col("ts")) - (F.col("event_id") % 3) * 2000000000
    return table(spark, d, "events").select("event_id", gzip_mtime(seconds).alias("mtime"))


@query("select l_orderkey, l_linenumber, (floor(l_extendedprice * 100000)::bigint % 4294967296)::bigint as isize from lineitem")
def gzip_isize_(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gzip_isize(F.floor(F.col("l_extendedprice") * 100000)).alias("isize"))


def _nations(spark, d) -> DataFrame:
    """Nations as files that hold their own name, with times days apart from 1979 on."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ordinal"), F.concat("n_name", F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("payload"))
    time = F.lit("1979-12-25 13:37:59").cast("timestamp_ntz") + F.make_dt_interval(F.col("ordinal").cast("int"))
    size = F.octet_length("payload").cast("long")
    return layout.offsets(n.select("ordinal", "name", F.crc32("payload").alias("crc32"), time.alias("mtime"), size.alias("compressed"), size.alias("uncompressed")), limit=200)


SQL_NATIONS = f"""{SQL_CRC},
e0 as (select n_nationkey::bigint as ordinal, n_name || '.txt' as name, {sql_crc('n_name')}::bigint as crc32, timestamp '1979-12-25 13:37:59' + to_days(n_nationkey::int) as mtime, length(n_name)::bigint as compressed, length(n_name)::bigint as uncompressed from nation, tab),
e1 as (select *, coalesce(sum(30 + length(name) + compressed) over (order by ordinal rows between unbounded preceding and 1 preceding), 0) as o from e0),
e2 as (select *, o >= 200 as zip64 from e1),
entries as (select *, coalesce(sum(30 + length(name) + (case when zip64 then 20 else 0 end) + compressed) over (order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as lfh_offset from e2)"""
SQL_COMMON = f"'0000' || '0800' || {sql_le(SQL_DOS.format(t='mtime'), 2)} || {sql_le(SQL_DATE.format(t='mtime'), 2)} || {sql_le('crc32', 4)}"


@query(f"""with {SQL_NATIONS} select ordinal, '504B0304' || (case when zip64 then '2D00' else '1400' end) || {SQL_COMMON} ||
  (case when zip64 then 'FFFFFFFFFFFFFFFF' else {sql_le('compressed', 4)} || {sql_le('uncompressed', 4)} end) || {sql_le('length(name)', 2)} || (case when zip64 then '1400' else '0000' end) || hex(encode(name)) ||
  (case when zip64 then '01001000' || {sql_le('uncompressed', 8)} || {sql_le('compressed', 8)} else '' end) as header from entries""")
def zip_headers(spark, d):
    return _nations(spark, d).select("ordinal", layout.local_header().alias("header"))


@query(f"""with {SQL_NATIONS} select ordinal, '504B0102' || (case when zip64 then '2D002D00' else '14001400' end) || {SQL_COMMON} || {sql_le('compressed', 4)} || {sql_le('uncompressed', 4)} || {sql_le('length(name)', 2)} ||
  (case when lfh_offset >= 200 then '0C00' else '0000' end) || '00000000000000000000' || (case when lfh_offset >= 200 then 'FFFFFFFF' else {sql_le('lfh_offset', 4)} end) || hex(encode(name)) ||
  (case when lfh_offset >= 200 then '01000800' || {sql_le('lfh_offset', 8)} else '' end) as header from entries""")
def zip_central(spark, d):
    """With the limit scaled to 200 bytes: only the offset overflows, so only it is replaced."""
    return _nations(spark, d).select("ordinal", layout.central_header(200).alias("header"))


@query(f"""with {SQL_NATIONS}, dir as (select count(*)::bigint as n, sum(30 + length(name) + (case when zip64 then 20 else 0 end) + compressed)::bigint as o,
  sum(46 + length(name) + (case when lfh_offset >= 200 then 12 else 0 end))::bigint as s from entries)
select '504B0606' || {sql_le('44', 8)} || '2D002D00' || '0000000000000000' || {sql_le('n', 8)} || {sql_le('n', 8)} || {sql_le('s', 8)} || {sql_le('o', 8)} || '504B0607' || '00000000' || {sql_le('o + s', 8)} || '01000000' ||
  '504B0506' || '00000000' || {sql_le('n', 2)} || {sql_le('n', 2)} || {sql_le('s', 4)} || {sql_le('o', 4)} || '0000' as records from dir""")
def zip_eocd(spark, d):
    return layout.directory(_nations(spark, d), limit=200).select(layout.end_records().alias("records"))


@query("select event_id, '1F8B0800' || " + sql_le("greatest(0, floor(epoch(ts))::bigint)", 4) + " || '00FF' as header from events")
def gzip_header(spark, d):
    return table(spark, d, "events").select("event_id", layout.gzip_header(epoch_seconds(F.col("ts"))).alias("header"))


@query("select item_id, md5(encode(coalesce(text, ''))) as digest from benchmark")
def gzip_roundtrip(spark, d):
    """Each item as a gzip member, read back by the standard library."""
    items = table(spark, d, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    body = deflate(F.col("payload"), F.lit(True))
    member = F.concat(F.unhex(layout.gzip_header(F.lit(0))), body, F.unhex(layout.gzip_trailer(F.crc32("payload"), F.octet_length("payload"))))
    return items.select("item_id", F.md5(gunzip(member)).alias("digest"))


@query(f"with {FILES} select archive_path, md5(payload) as digest from files")
def zip_roundtrip(spark, d):
    """The documents as a ZIP archive of blocks in the shared folder, read back entry by entry with the standard library."""
    files = ordered(documents(spark, d)).select("file_id", "ordinal", "archive_path", "size_bytes")
    source = read(split(documents(spark, d, payload=True).select("file_id", "size_bytes", "payload"), BLOCK))
    blocks = Kept(compressed(source, JobOptions()), "zip-blocks").df
    sums = assemble(blocks.select("file_id", "block_index", "crc32", "uncompressed", "compressed"))
    meta = Kept(sums.join(files, "file_id").withColumn("mtime", F.lit("2001-02-03 04:05:06").cast("timestamp_ntz")), "zip-files").df
    folder = shared_dir(spark)
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("the archive sink writes to a file system that all machines mount; spark.checkpoint.dir is none")
    path = f"{folder.removeprefix('file://')}/documents-{uuid.uuid4().hex}.zip"
    archives.write(archives.zip_rows(meta, blocks), path)
    discard(spark, f"file://{path}")

    def entries(batches):
        import hashlib
        import zipfile

        with zipfile.ZipFile(path) as z:
            for batch in batches:
                names = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"archive_path": names, "digest": [hashlib.md5(z.read(n)).hexdigest() for n in names]})

    return meta.select("archive_path").mapInArrow(entries, "archive_path string, digest string")
