"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own clean-up takes the rest
            return


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder when the interpreter ends."""
    _written.append((spark, path))


class Kept:
    """A table written to the shared folder: a lost executor recomputes nothing before it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path)
        self.schema = df.schema
        discard(self.spark, self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only for tables that no DataFrame handed out still reads."""
        _written.remove((self.spark, self.path))
        _delete(self.spark, self.path)


@contextmanager
def scratch() -> Iterator[Callable[[Kept], Kept]]:
    """Tables that are kept inside are deleted at the end, but those given to the function that it yields. For work whose
    result is written before the end; sessions that run side by side should not share one."""
    before, spared = len(_written), set()

    def spare(table: Kept) -> Kept:
        spared.add(table.path)
        return table

    try:
        yield spare
    finally:
        for spark, path in [x for x in _written[before:] if x[1] not in spared]:
            _written.remove((spark, path))
            _delete(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df
