"""python -m stowage pack INPUT... --output FILE [options]; python -m stowage info."""

from __future__ import annotations

import re
import sys

from .model import Algorithm, EngineOptions, Format, JobOptions, JobRequest, Level, PackError, Progress, capabilities

USAGE = """usage:
  stowage pack INPUT... --output FILE [--format zip|gzip|zstd] [--gpu | --no-gpu] [--gpu-threshold N[K|M|G]] [--block-bytes N[K|M|G]]
               [--threads N] [--io-threads N] [--level fast|balanced|best] [--overwrite] [--no-recurse] [--quiet]
  stowage info
--threads: tasks at a time; --io-threads: blocks that a task reads at a time; --quiet: no progress and no report"""
UNIT = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


class Usage(Exception):
    pass


def parse_size(text: str) -> int:
    m = re.fullmatch(r"([0-9]+)([KkMmGg]?)", text)
    if not m:
        raise Usage(f"invalid size {text!r}")
    return int(m[1]) * UNIT[m[2].upper()]


def parse_pack(args: list[str]) -> tuple[JobRequest, EngineOptions, bool]:
    inputs, got, left = [], {}, list(args)
    valued = {"--output", "--format", "--gpu-threshold", "--block-bytes", "--threads", "--io-threads", "--level"}
    flags = {"--gpu", "--no-gpu", "--overwrite", "--no-recurse", "--quiet"}
    while left:
        a = left.pop(0)
        if a in ("--help", "-h"):
            raise Usage("")
        if a in valued:
            if not left:
                raise Usage(f"missing value for {a}")
            got[a] = left.pop(0)
        elif a in flags:
            got[a] = True
        elif len(a) > 2 and a.startswith("--"):
            raise Usage(f"unknown option: {a}")
        else:
            inputs.append(a)
    if not inputs:
        raise Usage("no inputs")
    if "--output" not in got:
        raise Usage("missing --output")
    formats, levels = {f.name.lower(): f for f in Format}, {x.name.lower(): x for x in Level}
    if got.get("--format", "zip") not in formats or got.get("--level", "balanced") not in levels:
        raise Usage("unknown --format or --level value")
    sizes = {k: parse_size(got[k]) for k in ("--gpu-threshold", "--block-bytes", "--threads", "--io-threads") if k in got}
    plain = JobOptions()
    options = JobOptions(
        format=formats[got.get("--format", "zip")], algorithm=Algorithm.CPU_DEFLATE if "--no-gpu" in got else Algorithm.AUTO, level=levels[got.get("--level", "balanced")],
        gpu_threshold_bytes=sizes.get("--gpu-threshold", plain.gpu_threshold_bytes), block_bytes=sizes.get("--block-bytes", plain.block_bytes), recurse="--no-recurse" not in got, overwrite="--overwrite" in got,
    )
    threads = {k: v for k, v in (("cpu_codec_threads", sizes.get("--threads")), ("io_threads", sizes.get("--io-threads"))) if v}
    return JobRequest(tuple(inputs), got["--output"], options), EngineOptions(enable_gpu="--no-gpu" not in got, **threads), "--quiet" in got


def report(stats) -> str:
    lines = [f"{stats.files_processed} files, {stats.cpu_blocks} CPU blocks, {stats.gpu_blocks} GPU blocks, {stats.elapsed_ms} ms", f"{stats.input_bytes} -> {stats.output_bytes} bytes"]
    if stats.input_bytes > 0:
        ratio = stats.output_bytes / stats.input_bytes
        lines.append(f"ratio {ratio:.4f}, saved {100 * (1 - ratio):.1f} %")
    return "\n".join(lines)


def main(args: list[str]) -> int:
    if args == ["info"]:
        for k, v in capabilities().items():
            print(f"{k}: {v}")
        return 0
    if not args or args[0] != "pack":
        print(USAGE, file=sys.stderr)
        return 2
    try:
        request, options, quiet = parse_pack(args[1:])
    except Usage as e:
        print(f"{e}\n{USAGE}" if str(e) else USAGE, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .engine import Engine

    spark = SparkSession.builder.master(f"local[{options.cpu_codec_threads}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def show(p: Progress) -> None:
        print(f"\r{p.percent:5.1f} %  {p.processed_files}/{p.total_files} files  {p.throughput_mibps:.1f} MiB/s", end="", file=sys.stderr)

    try:
        stats = Engine(spark, options).run(request, None if quiet else show)
    except PackError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not quiet:
        print(f"\n{report(stats)}")
    return 0
