"""What the operators share: batch mapping and block packing.

Every operator takes a DataFrame and column names. Columns an operator does not need are pruned before any Python
code runs; where rows pass through, a result column replaces an input column of the same name, as the session compares
names. Columns that operators add for their own use get names that the input has not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Kept  # noqa: F401  for the operators


def folded(df: DataFrame) -> Callable[[str], str]:
    """What two names must have in common to be one to the session."""
    return (lambda name: name) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list:
    """All columns of df by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_hash(df: DataFrame, seed: int):
    """A hash of all columns but those that hold maps, which have no order. xxhash64 passes over nulls, so their places are added."""
    columns = [c for c, f in zip(own_columns(df), df.schema) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(F.lit(seed), F.concat_ws(",", *[c.isNull().cast("string") for c in columns]), *columns)


def sized(df: DataFrame, rows_: int, per: int) -> DataFrame:
    """df in about as many partitions as `per` rows each take, if those are fewer: small tables are not written as many files."""
    return df.coalesce(max(1, math.ceil(rows_ / per)))


def balanced(df: DataFrame, per: int = 32 << 20) -> DataFrame:
    """df for work in Python: a scan on all cores where it gives fewer partitions, and not in many more than cores and size ask
    for, so that small files are read, and results written, by few tasks. What comes from a shuffle stays as it is."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    size, parts = int(str(plan.optimizedPlan().stats().sizeInBytes())), plan.toRdd().getNumPartitions()
    if parts < cores and size > 1 << 20:
        return df.repartition(cores)
    most = min(1 << 30, max(2 * cores, -(-size // per)))
    return df.coalesce(most) if parts > most else df


def map_batches(df: DataFrame, added: str, fn: Callable[[pa.RecordBatch], dict], setup: Callable[[], object] | None = None) -> DataFrame:
    """Adds columns to every row. fn(batch) or fn(batch, setup()) gives the added columns; they replace columns of the same name."""
    new, same = T._parse_datatype_string(added), folded(df)
    names = {same(f.name) for f in new}
    kept = [i for i, f in enumerate(df.schema) if same(f.name) not in names]
    rest = [df.schema[i] for i in kept]
    schema = T.StructType([*rest, *new])
    target = arrow_schema(added)
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])  # mapInArrow refuses some names
    names_in = inner.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows:
                made = fn(batch, *state)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(made[f.name], type=f.type) for f in target)], names=names_in)

    return balanced(df).toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, inner).toDF(*schema.names)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(schema: str) -> pa.Schema:
    """Of a plain 'name type, ...' string; also works on executors."""
    return pa.schema([pa.field(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(","))])


def rows(schema: str, columns: dict) -> pa.RecordBatch:
    arrow = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def table(schema: str, columns: dict) -> pa.Table:
    return pa.Table.from_batches([rows(schema, columns)])


def squeeze(x: np.ndarray) -> bytes:
    """Little-endian values, byte plane after byte plane, compressed: small deltas cost little in a shuffle."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(raw)


def expand(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def frame(parts: list[bytes]) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unframe(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(b, "<u4", n, 4), dtype=np.int64)).tolist()
    return [bytes(b[s:e]) for s, e in zip([4 + 4 * n, *ends], ends)]


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about `most`; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes in the column, so that what is made of a batch does not depend on how small they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts_of(column: pa.Array) -> list[str]:
    """Null texts count as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def is_train(doc_id, modulus: int, held: int):
    """Column: the row may be learned from, as crc32(doc_id as text) mod modulus is not `held` (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus != held, F.lit(True))
