"""What the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import simhash
from stowage.llm.common import balanced, expand, frame, free, gathered, sized, squeeze, unframe


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=60), st.integers(1, 12), st.integers(1, 20))
def test_parts_are_cut_between_keys(pairs, per, most):
    pairs = sorted(pairs)
    batches = [pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in part], pa.int64()), "b": pa.array([p[1] for p in part], pa.int64()), "v": pa.array(range(s, s + len(part)), pa.int64())}) for s in range(0, len(pairs), per) if (part := pairs[s : s + per])]
    for lead in (1, 2):
        parts = list(simhash.cut_at(batches, lead, most))
        assert [v for p in parts for v in p[2].tolist()] == list(range(len(pairs)))
        keys = [{tuple(int(c[i]) for c in p[:lead]) for i in range(len(p[0]))} for p in parts]
        assert all(not x & y for i, x in enumerate(keys) for y in keys[:i])


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(max_size=9)), max_size=6), max_size=12), st.integers(1, 60))
def test_gathered_batches_hold_the_same_rows(parts, most):
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(p, pa.string())}) for p in parts]
    got = list(gathered(iter(batches), 0, most))
    assert [t for b in got for t in b.column(0).to_pylist()] == [t for p in parts for t in p] and all(b.num_rows for b in got)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.binary(max_size=20), max_size=6))
def test_packed_values_come_back(values, parts):
    assert expand(squeeze(np.array(values, "<u8")), "<u8").tolist() == values and unframe(frame(parts)) == parts


def test_names_are_free(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, _a int, b int")
    assert free(df, "a", "B", "c", "C") == ["__a", "_B", "c", "_C"]


def test_partitions_follow_cores_and_size(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(60_000).selectExpr("id", "uuid() as t").repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(4000).selectExpr("id", "repeat(uuid(), 50) as t").repartition(30).write.parquet(str(tmp_path / "many"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        many = balanced(spark.read.parquet(str(tmp_path / "many")))
        assert many.rdd.getNumPartitions() == 2 * cores and many.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = balanced(spark.read.parquet(str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == cores and one.count() == 60_000
    joined = spark.range(100).repartition(50).groupBy("id").count()
    assert balanced(joined) is joined
    assert sized(spark.range(100).repartition(50), 100, 60).rdd.getNumPartitions() == 2
