"""Checksums, routing, archives, scanning, jobs and the command line."""

from __future__ import annotations

import gzip
import os
import struct
import threading
import time
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage import cli
from stowage.engine import Engine
from stowage.functions.crc import combine, combine_col
from stowage.functions.wire import dos_date, dos_time, gzip_mtime, parse_size, path_below
from stowage.model import Algorithm, EngineOptions, Format, JobOptions, JobRequest, Level, PackError, Progress, Status, capabilities
from stowage.operators import layout
from stowage.operators.assemble import assemble, before, numbered
from stowage.operators.blocks import route, split
from stowage.operators.codec import deflate_batch, deflate_bytes, deflate_runs, inflate_bytes
from stowage.shared import Kept, scratch
from stowage.sources import files
from stowage.sources.files import blocks, scan
from stowage.streaming.progress import Throttle


def random_bytes(n: int, seed: int) -> bytes:
    return (np.random.RandomState(seed).randint(0, 2**32, n, dtype=np.uint32) & 0xFF).astype(np.uint8).tobytes()


def test_crc_known_values(spark):
    rows = spark.createDataFrame([(b"",), (b"123456789",)], "x binary").select(F.crc32("x")).collect()
    assert [r[0] for r in rows] == [0, 0xCBF43926]


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_combine_is_the_crc_of_both(a, b):
    assert combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_combine_column(spark):
    pairs = [(b"front-half-of-data", b"and-the-back-half!"), (b"", b"x"), (b"x", b""), (b"the quick ", b"brown fox jumps over the lazy dog"), (b"a" * 5000, b"b" * 70000)]
    df = spark.createDataFrame([(zlib.crc32(a), zlib.crc32(b), len(b), zlib.crc32(a + b)) for a, b in pairs], "a long, b long, n long, want long")
    got = df.select(combine_col(F.col("a"), F.col("b"), F.col("n")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


@pytest.mark.parametrize(
    "algorithm, gpu, threshold, size, want",
    [
        (Algorithm.AUTO, True, 1 << 20, 2 << 20, "Gpu"), (Algorithm.AUTO, True, 1 << 20, 1 << 19, "Cpu"), (Algorithm.AUTO, False, 1 << 20, 1 << 30, "Cpu"), (Algorithm.CPU_DEFLATE, True, 1 << 20, 1 << 30, "Cpu"),
        (Algorithm.GPU_DEFLATE, True, 1 << 20, 0, "Gpu"), (Algorithm.GPU_DEFLATE, True, 1 << 20, 1, "Gpu"), (Algorithm.AUTO, True, 4096, 4096, "Gpu"), (Algorithm.AUTO, True, 4096, 4095, "Cpu"),
    ],
)
def test_route(spark, algorithm, gpu, threshold, size, want):
    assert spark.range(1).select(route(F.lit(size), algorithm, gpu, threshold)).first()[0] == want


@pytest.mark.parametrize("block", [1, 7, 64])
def test_split_covers_every_size(spark, block):
    sizes = [0, 1, block - 1, block, block + 1, 2 * block, 2 * block + 1]
    rows = split(spark.createDataFrame(list(enumerate(sizes)), "file_id long, size_bytes long"), block).collect()
    for i, n in enumerate(sizes):
        own = sorted((r for r in rows if r["file_id"] == i), key=lambda r: r["block_index"])
        assert len(own) == max(1, -(-n // block)) and sum(r["used_bytes"] for r in own) == n
        assert [r["is_last"] for r in own] == [False] * (len(own) - 1) + [True]


@settings(deadline=None, max_examples=40)
@given(st.binary(max_size=2000), st.integers(1, 300), st.sampled_from([1, -1, 9]))
def test_blocks_are_one_stream(data, block, level):
    parts = [data[i : i + block] for i in range(0, len(data), block)] or [b""]
    joined = b"".join(deflate_bytes(p, i + 1 == len(parts), level) for i, p in enumerate(parts))
    assert inflate_bytes(joined) == data


def test_batch():
    out: list = [None] * 3
    deflate_batch([b"ab", b"", b"c" * 999], out)
    assert inflate_bytes(b"".join(out)) == b"ab" + b"c" * 999
    deflate_batch([], [])
    with pytest.raises(PackError) as e:
        deflate_batch([b"x"], [])
    assert e.value.code == Status.INVALID_ARGUMENT


def test_batches_by_file():
    data = {1: [b"ab" * 50, b"c" * 70], 2: [b""], 3: [b"x" * 10, b"y", b"z" * 99]}
    ids, last, parts = zip(*[(i, k + 1 == len(d), p) for i, d in data.items() for k, p in enumerate(d)])
    for cut in range(len(parts) + 1):  # a file may go on in the next batch
        made = [x for a, b in ((0, cut), (cut, len(parts))) for x in deflate_runs(list(ids[a:b]), list(last[a:b]), list(parts[a:b]), Level.FAST)]
        for i, d in data.items():
            assert inflate_bytes(b"".join(m for j, m in zip(ids, made) if j == i)) == b"".join(d)


def test_empty_block_is_a_stream():
    assert deflate_bytes(b"", True, -1) == b"\x03\x00"


def test_header_fields(spark):
    times = ["1979-12-31 23:59:59", "1980-01-01 00:00:00", "2024-02-29 13:37:59", "2107-12-31 23:59:58", "2108-01-01 00:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t")).select(dos_date(F.col("t")), dos_time(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(33, 0), (33, 0), (44 << 9 | 2 << 5 | 29, 13 << 11 | 37 << 5 | 29), (127 << 9 | 12 << 5 | 31, 23 << 11 | 59 << 5 | 29), (0 << 9 | 1 << 5 | 1, 0)]
    assert spark.range(1).select(gzip_mtime(F.lit(-5)), gzip_mtime(F.lit(2**32 + 3))).first()[:] == (0, 3)


@pytest.mark.parametrize("text, want", [("1024", 1024), ("1K", 1024), ("1m", 1 << 20), ("2G", 2 << 30), ("1MiB", None), ("", None), ("K", None), ("-1", None)])
def test_parse_size(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(parse_size(F.col("s"))).first()[0] == want
    if want is None:
        with pytest.raises(cli.Usage):
            cli.parse_size(text)
    else:
        assert cli.parse_size(text) == want


def test_prefix_sums_over_many_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    want, total = {}, 0
    for i in range(1000):
        want[i] = total
        total += i % 7
    assert {r["id"]: r["s"] for r in before(df, "v", "id", "s", bucket=64).collect()} == want
    got = numbered(df, ["v", "id"], "n").orderBy("v", "id").collect()
    assert [r["n"] for r in got] == list(range(1000)) and numbered(df.limit(0), ["v", "id"], "n").count() == 0


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_checksums_combine_in_ranges(spark, fan):
    data = {1: random_bytes(997, 5), 2: b"", 3: b"abc"}
    rows = [(i, k, zlib.crc32(p := d[s : s + 10]), len(p), 1) for i, d in data.items() for k, s in enumerate(range(0, max(1, len(d)), 10))]
    got = assemble(spark.createDataFrame(rows[::-1], "file_id long, block_index int, crc32 long, uncompressed long, compressed long"), fan).collect()
    assert {r["file_id"]: (r["blocks"], r["file_crc32"], r["uncompressed"], r["compressed"]) for r in got} == {i: (max(1, -(-len(d) // 10)), zlib.crc32(d), len(d), max(1, -(-len(d) // 10))) for i, d in data.items()}


def test_combine_over_very_long_parts(spark):
    """Lengths of 2^48 and more, against the plain rule."""
    for n in (2**48, 2**48 + 5, 2**62 + 2**50 + 3):
        assert spark.range(1).select(combine_col(F.lit(0x12345678).cast("long"), F.lit(0x9ABCDEF0).cast("long"), F.lit(n))).first()[0] == combine(0x12345678, 0x9ABCDEF0, n)


@settings(deadline=None, max_examples=5)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12))
def test_zip64_flags_follow_the_sequential_rule(spark, sizes):
    limit = 400
    df = spark.createDataFrame([(i, f"n{i}", n, n) for i, n in enumerate(sizes)], "ordinal long, name string, compressed long, uncompressed long")
    at, want = 0, []
    for i, n in enumerate(sizes):
        flag = n >= limit or at >= limit
        want.append((at, flag))
        at += 30 + len(f"n{i}") + (20 if flag else 0) + n
    got = layout.offsets(df, limit, bucket=4).orderBy("ordinal").collect()
    assert [(r["lfh_offset"], r["zip64"]) for r in got] == want


@pytest.mark.parametrize("entries, want", [(65534, False), (65535, True), (65536, True)])
def test_many_entries_need_zip64(spark, entries, want):
    df = spark.range(entries).select(F.col("id").alias("ordinal"), F.lit("a").alias("name"), F.lit(0).cast("long").alias("compressed"), F.lit(0).cast("long").alias("uncompressed"))
    assert layout.directory(layout.offsets(df)).first()["zip64"] is want


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    (root / "a").mkdir(parents=True)
    (root / "sub").mkdir()
    for name, content in {"a/b": b"ab" * 5000, "a.txt": b"text", "a-z": b"-", "sub/empty": b"", "sub/é.txt": "é".encode() * 3000, "big.bin": random_bytes(70_000, 3)}.items():
        (root / name).write_bytes(content)
    return root


def found_by(spark, inputs: list, **options) -> list:
    return scan(spark, [str(x) for x in inputs], **options).orderBy("ordinal").collect()


def test_scan_order_and_ids(spark, tree):
    found = found_by(spark, [tree])
    assert [e.archive_path for e in found] == ["data/a/b", "data/a-z", "data/a.txt", "data/big.bin", "data/sub/empty", "data/sub/é.txt"]
    assert sorted(e.file_id for e in found) == [1, 2, 3, 4, 5, 6] and [e.ordinal for e in found] == list(range(6))
    assert [e.archive_path for e in sorted(found, key=lambda e: e.file_id)] == ["data/a-z", "data/a.txt", "data/big.bin", "data/a/b", "data/sub/empty", "data/sub/é.txt"]  # a directory before those in it
    assert [e.archive_path for e in found_by(spark, [tree], recurse=False)] == ["data/a-z", "data/a.txt", "data/big.bin"]
    assert [e.archive_path for e in found_by(spark, [tree / "big.bin", tree / "a.txt", tree / "a.txt"])] == ["big.bin", "a.txt", "a.txt"]
    assert [e.archive_path for e in found_by(spark, [tree / "sub", tree / "a.txt", tree / "a"])] == ["sub/empty", "sub/é.txt", "a.txt", "a/b"]
    assert [e.archive_path for e in found_by(spark, [tree], exclude=str(tree / "a" / ".." / "a" / "b"))][0] == "data/a-z"


def test_scan_of_many_directories(spark, tmp_path):
    """More directories than a task lists, in several levels, against a walk in one piece."""
    for i in range(90):
        folder = tmp_path / "t" / f"d{i % 9}" / f"e{i}"
        folder.mkdir(parents=True)
        (folder / "f.txt").write_text("x" * i)
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    want = sorted((Path(d) / f for d, _, names in os.walk(tmp_path / "t") for f in names), key=lambda p: p.parts)
    found = found_by(spark, [tmp_path / "t"])
    assert [e.source for e in found] == [str(p) for p in want] and [e.size_bytes for e in found] == [p.stat().st_size for p in want]


def test_archive_path_rule(spark):
    cases = [("data/sub/foo", "data", "sub/foo"), ("x/data/sub/foo", "x/data", "data/sub/foo"), ("/data/sub/foo", "/data", "data/sub/foo"), ("/a/b/data/f", "/a/b/data/", "data/f"), ("é/d/ü", "é/d", "d/ü")]
    df = spark.createDataFrame(cases, "path string, root string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", path_below(F.col("path"), F.col("root"))).collect())


def test_scan_errors(spark, tmp_path):
    with pytest.raises(PackError) as e:
        scan(spark, [str(tmp_path / "none")])
    assert e.value.code == Status.NOT_FOUND
    os.mkfifo(tmp_path / "pipe")
    with pytest.raises(PackError) as e:
        scan(spark, [str(tmp_path / "pipe")])
    assert e.value.code == Status.INVALID_ARGUMENT


@pytest.mark.parametrize("threads", [1, 3])
def test_blocks_are_ranges_of_their_files(spark, tree, threads):
    manifest = scan(spark, [str(tree)])
    rows = blocks(manifest, 4096, threads).orderBy("file_id", "block_index").collect()
    for e in manifest.collect():
        assert b"".join(bytes(r["payload"]) for r in rows if r["file_id"] == e.file_id) == Path(e.source).read_bytes()


def test_read_ahead_holds_as_many_as_threads(monkeypatch):
    now, most, lock = [0], [0], threading.Lock()

    def slow(path, offset, size):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return bytes([offset])

    monkeypatch.setattr(files, "read_range", slow)
    for threads in (1, 4):
        most[0] = 0
        assert list(files.read_ahead([("x", k, 1) for k in range(12)], threads)) == [bytes([k]) for k in range(12)] and most[0] == threads


def test_manifest_source(spark, tree):
    from stowage.sources.files import register

    register(spark)
    import json

    df = spark.read.format("packfiles").option("inputs", json.dumps([str(tree), str(tree / "a.txt")])).load()
    assert df.count() == 7 and df.agg(F.sum("size_bytes")).first()[0] == 10000 + 4 + 1 + 0 + 6000 + 70000 + 4
    assert spark.read.format("packfiles").option("inputs", json.dumps([str(tree)])).option("recurse", "false").load().count() == 3


def test_shrunk_file_is_an_error(spark, tree):
    manifest = scan(spark, [str(tree / "big.bin")])
    (tree / "big.bin").write_bytes(b"short")
    with pytest.raises(Exception, match="IO"):
        blocks(manifest, 4096).count()


@pytest.mark.parametrize("block", [4096, 1 << 23])
def test_zip_reads_back(spark, tree, block):
    out = tree.parent / "o.zip"
    seen: list[Progress] = []
    stats = Engine(spark).run(JobRequest((str(tree),), str(out), JobOptions(block_bytes=block, algorithm=Algorithm.CPU_DEFLATE)), seen.append)
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None
        assert z.namelist() == ["data/a/b", "data/a-z", "data/a.txt", "data/big.bin", "data/sub/empty", "data/sub/é.txt"]
        for i in z.infolist():
            assert z.read(i) == (tree.parent / i.filename).read_bytes() and i.compress_type == 8
    raw = out.read_bytes()
    assert raw[:4] == struct.pack("<I", 0x04034B50) and raw[-22:-18] == struct.pack("<I", 0x06054B50) and struct.unpack("<HH", raw[-14:-10]) == (6, 6)
    assert stats.input_bytes == 86005 and stats.files_processed == 6 and stats.archive_bytes == len(raw) and stats.gpu_blocks == 0 and stats.files_skipped == 0
    assert seen[-1].processed_bytes == 86005 and seen[-1].percent == 100


def test_two_random_files(spark, tmp_path):
    for name, n, seed in (("a.bin", 65536, 1), ("b.bin", 98304, 2)):
        (tmp_path / name).write_bytes(random_bytes(n, seed))
    out = tmp_path / "o.zip"
    stats = Engine(spark, EngineOptions(enable_gpu=False)).run(JobRequest((str(tmp_path / "a.bin"), str(tmp_path / "b.bin")), str(out), JobOptions(algorithm=Algorithm.CPU_DEFLATE, overwrite=True)))
    raw = out.read_bytes()
    n, m = struct.unpack("<HH", raw[26:30])
    size = struct.unpack("<I", raw[18:22])[0]
    assert stats.input_bytes == 65536 + 98304 and inflate_bytes(raw[30 + n + m : 30 + n + m + size]) == random_bytes(65536, 1)


@pytest.mark.parametrize("level", list(Level))
def test_gzip_reads_back(spark, tree, level):
    out = tree.parent / f"{level.name}.gz"
    Engine(spark).run(JobRequest((str(tree / "big.bin"),), str(out), JobOptions(format=Format.GZIP, block_bytes=4096, level=level)))
    assert gzip.decompress(out.read_bytes()) == (tree / "big.bin").read_bytes()


def test_job_errors(spark, tree):
    out = tree.parent / "exists.zip"
    out.write_bytes(b"x")
    engine = Engine(spark)

    def code(request):
        with pytest.raises(PackError) as e:
            engine.run(request)
        return e.value.code

    assert code(JobRequest((), "o")) == code(JobRequest(("x",), "")) == Status.INVALID_ARGUMENT
    assert code(JobRequest((str(tree),), str(out))) == Status.INVALID_ARGUMENT and out.read_bytes() == b"x"
    assert code(JobRequest((str(tree),), str(tree.parent / "o.zst"), JobOptions(format=Format.ZSTD))) == Status.UNSUPPORTED
    assert code(JobRequest((str(tree),), str(tree.parent / "o.gz"), JobOptions(format=Format.GZIP))) == Status.FORMAT_ERROR
    empty = tree.parent / "none"
    empty.mkdir()
    assert code(JobRequest((str(empty),), str(tree.parent / "o.zip"))) == Status.INVALID_ARGUMENT
    engine.run(JobRequest((str(tree),), str(out), JobOptions(overwrite=True)))
    assert zipfile.ZipFile(out).testzip() is None
    inside = tree / "inside.zip"
    inside.write_bytes(b"old")
    engine.run(JobRequest((str(tree),), str(inside), JobOptions(overwrite=True)))
    assert "data/inside.zip" not in zipfile.ZipFile(inside).namelist()


def test_handle(spark, tree):
    out = tree.parent / "h.zip"
    handle = Engine(spark).submit(JobRequest((str(tree),), str(out)))
    assert handle.wait() is None and handle.wait() is None and handle.done() and handle.error() is None and handle.stats().files_processed == 6
    assert handle.progress().processed_files == 6
    stopped = Engine(spark).submit(JobRequest((str(tree),), str(tree.parent / "c.zip"), JobOptions(block_bytes=16)))
    time.sleep(0.2)
    stopped.cancel()
    error = stopped.wait()
    assert error and error.code == Status.CANCELLED and not (tree.parent / "c.zip").exists()


def test_progress_rises_while_the_job_runs(spark, tmp_path, monkeypatch):
    """Files and bytes are reported as tasks end, before the job does."""
    from stowage.plans import pack
    from stowage.sources import files as source

    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / "in" / f"{i:02}.bin").write_bytes(random_bytes(20_000, i))
    monkeypatch.setattr(source, "TASK_BYTES", 50_000)  # many tasks
    seen: list[Progress] = []
    stats = Engine(spark).run(JobRequest((str(tmp_path / "in"),), str(tmp_path / "o.zip"), JobOptions(block_bytes=8192, level=Level.BEST)), seen.append)
    between = sorted({p.processed_files for p in seen if 0 < p.processed_files < 40})
    assert between and all(0 < p.output_bytes and p.processed_bytes <= 800_000 for p in seen if p.processed_files)
    assert [p.processed_bytes for p in seen] == sorted(p.processed_bytes for p in seen) and stats.files_processed == 40 and seen[-1].processed_files == 40
    assert pack.EngineOptions().io_threads == 4


def test_progress_is_throttled():
    now, seen = [0.0], []
    t = Throttle(seen.append, clock=lambda: now[0])
    for k in range(10):
        now[0] = 0.01 * (k + 1)
        t.update(total_bytes=10 << 20, processed_bytes=(k + 1) << 20)
    assert len(seen) == 2 and seen[0].processed_bytes == 1 << 20
    t.flush()
    assert len(seen) == 3 and seen[-1].percent == 100 and seen[-1].throughput_mibps == pytest.approx(100)
    assert Progress().percent == 0


def test_command_line(tree, capsys):
    assert cli.main(["info"]) == 0 and "cpu-deflate" in capsys.readouterr().out
    for bad in ([], ["x"], ["pack"], ["pack", "a"], ["pack", "--help"], ["pack", "a", "--output", "o", "--nope"], ["pack", "a", "--output", "o", "--gpu-threshold", "1MiB"], ["pack", "a", "--output"], ["pack", "a", "--output", "o", "--level", "x"]):
        assert cli.main(bad) == 2
    request, engine, quiet = cli.parse_pack(["a", "--output", "o.gz", "--format", "gzip", "--no-gpu", "--block-bytes", "4K", "--threads", "3", "--level", "best", "--no-recurse", "--overwrite", "--quiet"])
    assert request.options == JobOptions(Format.GZIP, Algorithm.CPU_DEFLATE, Level.BEST, block_bytes=4096, recurse=False, overwrite=True) and engine.cpu_codec_threads == 3 and not engine.enable_gpu and quiet
    assert cli.parse_pack(["a", "--output", "o", "--gpu"])[0].options.algorithm == Algorithm.AUTO


def test_command_line_packs(spark, tree):
    assert cli.main(["pack", str(tree), "--output", str(tree.parent / "cli.zip"), "--quiet"]) == 0
    assert cli.main(["pack", str(tree / "none"), "--output", str(tree.parent / "n.zip"), "--quiet"]) == 1
    assert zipfile.ZipFile(tree.parent / "cli.zip").testzip() is None


def test_scratch_tables_are_deleted(spark):
    with scratch() as spare:
        gone, stays = Kept(spark.range(3), "gone"), spare(Kept(spark.range(4), "stays"))
    assert stays.df.count() == 4 and not os.path.exists(gone.path.removeprefix("file:")) and os.path.exists(stays.path.removeprefix("file:"))
    stays.drop()


def test_options():
    assert EngineOptions(gpu_memory_budget_mib=900, gpu_streams=0).staging_bytes() == 900 << 20 and EngineOptions().staging_bytes() == (1 << 30) // 3
    assert capabilities()["has_cuda"] is False
