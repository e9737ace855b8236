"""Gives the executors this package, so that Python code runs where the repository is not installed."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .shared import shared_dir

_shipped: set[tuple[str, str]] = set()
#: Spark's setting of the bytes that go to Python at once, its default, and what whole texts and files call for.
BATCH, USUAL, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application once; the name carries a hash of the content. Where the session has not
    set the bytes of an Arrow batch itself, they are set to SMALL: a batch is held several times over by JVM and worker."""
    if spark.conf.get(BATCH, USUAL) == USUAL:
        spark.conf.set(BATCH, SMALL)
    package = Path(__file__).resolve().parent
    files = sorted(package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    sc = spark.sparkContext
    if (sc.applicationId, digest) in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in files:
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    # into the shared folder, through Hadoop: that may be any store
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stowage_{digest}.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())
    _shipped.add((sc.applicationId, digest))
