"""Structured Streaming forms of the event operators.

Each reads the events table as a stream, keeps its state in the checkpoint, and here runs over all that is there (availableNow) into a
table of the shared folder. The watermark of ten minutes is our choice; the input is in time order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from quern.operators.state import LIMIT, WINDOW_US, micros
from quern.session import scratch_path, ship_package

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, ts as an instant."""
    ship_package(spark)
    path = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(path).schema
    source = path if os.path.isdir(path) else os.path.join(sf_dir, "[e]vents.parquet")  # a lone file must be named by a pattern
    return spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there. Without keys its rows are appended; with keys each batch writes the rows it has changed, and
    the newest of each key counts. A batch that is run again after a failure writes over what it wrote before."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True)
    if keys is None:
        running = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        running = writer.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    running.awaitTermination()
    if keys is None:
        return spark.read.schema(stream.schema).parquet(out)
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(out)
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("r"))
    return newest.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others)).select(*stream.columns)


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return run_once(counts.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", "total"), "hourly", ["hour_us", "event_type"])


def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    return run_once(events.groupBy("user_id", "props").agg(F.min_by("event_id", F.struct(micros(), "event_id")).alias("event_id")), "requests", ["user_id", "props"])


def last_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    return run_once(events.groupBy("user_id").agg(F.max_by("event_type", F.struct(micros(), "event_id")).alias("event_type")), "phases", ["user_id"])


def without_repeats(events: DataFrame, keys: list[str], span: str = "24 hours") -> DataFrame:
    """A stream without events that repeat a key within the span of its watermark."""
    return events.withWatermark("ts", span).dropDuplicatesWithinWatermark(keys)


def _limited(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    start, count = state.get if state.exists else (0, 0)
    opened = state.exists
    for pdf in batches:
        pdf = pdf.sort_values(["at_us", "event_id"])
        starts, nth = [], []
        for at in pdf["at_us"]:
            if not opened or at - start >= WINDOW_US:
                start, count, opened = int(at), 0, True
            count += 1
            starts.append(start)
            nth.append(count)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "user_id": key[0], "window_start_us": starts, "nth": nth, "allowed": [n <= LIMIT for n in nth]})
    if opened:
        state.update((start, count))


def window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-window limits with two numbers of state per user."""
    events = event_stream(spark, sf_dir).where("user_id is not null").select("event_id", "user_id", micros().alias("at_us"))
    limited = events.groupBy("user_id").applyInPandasWithState(
        _limited, "event_id long, user_id long, window_start_us long, nth long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout
    )
    return run_once(limited, "limits")
