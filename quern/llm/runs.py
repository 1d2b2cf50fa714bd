"""Sorted runs: range-partitioned, externally sorted rows whose adjacent equal keys are found by one scan.

The range partitioning takes the id as its last key, so a key held by very many rows is spread over several partitions. A run that
crosses partitions is put together afterwards from the first and last run of each partition, two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quern.session import written


def first_of_runs(df: DataFrame, keys: list[str], id_col: str = "entry_id") -> DataFrame:
    """(entry_id, keep_id) of every row with no null key: keep_id is the smallest id among the rows with equal keys."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.select(F.col(id_col).alias("entry_id"), *keys).dropna(subset=[*keys, "entry_id"]).withColumn("digest", F.xxhash64(*keys))
    ordered = kept.repartitionByRange(n, *keys, "entry_id").sortWithinPartitions(*keys, "entry_id")
    schema = _parse_datatype_string("entry_id long, keep_id long, digest long, marker boolean" + "".join(f", k{i} string" for i in range(len(keys))))
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        keep = digest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [batch.column(i + 1) for i in range(len(keys))]
            starts = np.zeros(len(ids), bool)
            for c in columns:
                starts[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            head = tuple(c[0].as_py() for c in columns)
            starts[0] = head != last
            at = np.maximum.accumulate(np.where(starts, np.arange(len(ids)), -1))
            keeps = np.where(at >= 0, ids[np.maximum(at, 0)], keep if keep is not None else 0)
            yield _batch(arrow, ids, keeps, batch.column(len(keys) + 1))
            if last is None:
                yield _marker(arrow, int(keeps[0]), batch.column(len(keys) + 1)[0], head)
            last, keep, digest = tuple(c[-1].as_py() for c in columns), int(keeps[-1]), batch.column(len(keys) + 1)[-1]
        if last is not None:
            yield _marker(arrow, keep, digest, last)

    scanned = written(ordered.mapInArrow(scan, schema), "runs")
    names = [f"k{i}" for i in range(len(keys))]
    marks = scanned.where("marker").select("keep_id", "digest", *names)
    first = marks.groupBy(*names).agg(F.min("keep_id").alias("first_id"))
    # an id repeated with other keys has runs of its own: a run is told by its first id and the digest of its keys
    moved = marks.join(first, names).where("keep_id <> first_id").select("keep_id", "digest", "first_id").distinct()
    rows = scanned.where("not marker").select("entry_id", "keep_id", "digest")
    return rows.join(F.broadcast(moved), ["keep_id", "digest"], "left").select("entry_id", F.coalesce("first_id", "keep_id").alias("keep_id"))


def _batch(schema: pa.Schema, ids: np.ndarray, keeps: np.ndarray, digests: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    nothing = [pa.nulls(n, f.type) for f in list(schema)[4:]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keeps, pa.int64()), digests, pa.array(np.zeros(n, bool)), *nothing], schema=schema)


def _marker(schema: pa.Schema, keep: int, digest: pa.Scalar, key: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([keep], pa.int64()), pa.array([digest.as_py()], pa.int64()), pa.array([True]), *(pa.array([k], pa.string()) for k in key)], schema=schema)
