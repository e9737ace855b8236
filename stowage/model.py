"""Options, enumerations, errors and record types of the packing engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T


class Format(IntEnum):
    ZIP = 0
    GZIP = 1
    ZSTD = 2


class Algorithm(IntEnum):
    AUTO = 0
    CPU_DEFLATE = 1
    GPU_DEFLATE = 2
    GPU_GDEFLATE = 3
    CPU_ZSTD = 4
    GPU_ZSTD = 5


class Level(IntEnum):
    FAST = 0
    BALANCED = 1
    BEST = 2


class Status(IntEnum):
    OK = 0
    CANCELLED = 1
    INVALID_ARGUMENT = 2
    NOT_FOUND = 3
    PERMISSION_DENIED = 4
    IO = 5
    OUT_OF_MEMORY = 6
    CUDA_ERROR = 7
    NVCOMP_ERROR = 8
    CODEC_ERROR = 9
    FORMAT_ERROR = 10
    UNSUPPORTED = 11
    INTERNAL = 12


class PackError(Exception):
    def __init__(self, code: Status, message: str):
        super().__init__(f"{code.name}: {message}")
        self.code, self.message = code, message


MIB = 1 << 20
#: zlib's numbers for the levels.
ZLIB_LEVEL = {Level.FAST: 1, Level.BALANCED: -1, Level.BEST: 9}
EXTENSION = {Format.ZIP: ".zip", Format.GZIP: ".gz", Format.ZSTD: ".zst"}


def is_archive(format: Format) -> bool:
    """Whether the format holds several files."""
    return format == Format.ZIP


@dataclass(frozen=True)
class EngineOptions:
    io_threads: int = 4
    cpu_codec_threads: int = field(default_factory=lambda: os.cpu_count() or 1)
    enable_gpu: bool = True
    cuda_device: int = 0
    gpu_streams: int = 3
    gpu_memory_budget_mib: int = 1024

    def staging_bytes(self) -> int:
        """Budget of one staging slot."""
        return self.gpu_memory_budget_mib * MIB // max(self.gpu_streams, 1)


@dataclass(frozen=True)
class JobOptions:
    format: Format = Format.ZIP
    algorithm: Algorithm = Algorithm.AUTO
    level: Level = Level.BALANCED
    gpu_threshold_bytes: int = MIB
    gpu_batch_bytes: int = 256 * MIB  # carried, without effect
    block_bytes: int = 8 * MIB
    recurse: bool = True
    overwrite: bool = False
    zone: str = "UTC"  # of the DOS times in archives


@dataclass(frozen=True)
class JobRequest:
    inputs: tuple[str, ...]
    output: str
    options: JobOptions = JobOptions()


@dataclass
class JobStats:
    files_processed: int = 0
    files_skipped: int = 0
    input_bytes: int = 0
    output_bytes: int = 0
    cpu_blocks: int = 0
    gpu_blocks: int = 0
    elapsed_ms: int = 0
    archive_bytes: int = 0


@dataclass(frozen=True)
class Progress:
    total_files: int = 0
    total_bytes: int = 0
    processed_files: int = 0
    processed_bytes: int = 0
    output_bytes: int = 0
    current_file: str = ""
    throughput_mibps: float = 0.0

    @property
    def percent(self) -> float:
        return 100 * self.processed_bytes / self.total_bytes if self.total_bytes else 0.0


def capabilities() -> dict:
    return {"has_cuda": False, "cuda_device_count": 0, "device_names": [], "supported": ["cpu-deflate"]}


MANIFEST = T.StructType(
    [
        T.StructField("file_id", T.LongType(), False),
        T.StructField("ordinal", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("archive_path", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("mtime", T.TimestampNTZType(), False),
    ]
)
