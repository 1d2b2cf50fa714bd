"""State of queues, quotas and workers replayed from event tables. Plain counts are windows; what depends on earlier decisions is a
stream through sorted partitions that keeps a constant-size state per key, however many events a key has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

DAY_US, WINDOW_US, LIMIT, ONLINE_US, QUEUE_US = 86_400_000_000, 900_000_000, 5, 90_000_000, 900_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_counts(events: DataFrame, by: list[str], span_us: int = DAY_US) -> DataFrame:
    """Each event with the number of events of its key in the span before it, itself included; exactly a span old is outside."""
    at = events.withColumn("at_us", micros())
    w = Window.partitionBy(*by).orderBy("at_us").rangeBetween(-(span_us - 1), 0)
    return at.withColumn("n_in_span", F.count(F.lit(1)).over(w))


def fixed_windows(events: DataFrame, key: str = "user_id", span_us: int = WINDOW_US, limit: int = LIMIT) -> DataFrame:
    """(event_id, key, window_start_us, nth, allowed): a window opens with the first event after the last one closed, so windows are not
    aligned to the clock. Partitions hold whole keys in time order and are streamed; the state of a key is two numbers."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select("event_id", F.col(key).alias("k"), micros().alias("at_us")).where("k is not null and at_us is not null").repartition(n, "k").sortWithinPartitions("k", "at_us", "event_id")
    schema = _parse_datatype_string(f"event_id long, {key} long, window_start_us long, nth long, allowed boolean")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, count = None, 0, 0
        for batch in batches:
            out = ([], [], [], [], [])
            for event, k, at in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now or at - start >= span_us:
                    now, start, count = k, at, 0
                count += 1
                for column, value in zip(out, (event, k, start, count, count <= limit)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return ordered.mapInArrow(scan, schema)


def online(events: DataFrame, key: str, seen: Column, span_us: int = ONLINE_US) -> DataFrame:
    """(key, last_seen_us, online): whether the last seen event is at most a span before the last of all."""
    clock = events.agg(F.max(micros()).alias("now_us"))
    last = events.where(seen).groupBy(key).agg(F.max(micros()).alias("last_seen_us"))
    return last.crossJoin(F.broadcast(clock)).select(key, "last_seen_us", (F.col("now_us") - F.col("last_seen_us") <= span_us).alias("online"))


def first_of_request(events: DataFrame, keys: list[str], id_col: str = "event_id") -> DataFrame:
    """The first event of each request key; later ones are repetitions of it."""
    return events.groupBy(*keys).agg(F.min_by(id_col, F.struct(micros(), F.col(id_col))).alias(id_col), F.count(F.lit(1)).alias("n_requests"))


def last_state(events: DataFrame, key: str, value: str, id_col: str = "event_id") -> DataFrame:
    """The value of each key's last event."""
    order = F.struct(micros(), F.col(id_col))
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(micros()).alias("at_us"))


def expired(events: DataFrame, key: str, opened: Column, answered: Column, span_us: int = QUEUE_US) -> DataFrame:
    """Opening events that no answer of the same key followed within the span: the next answer by a window, no join."""
    at = events.withColumn("at_us", micros()).withColumn("answer_us", F.when(answered, F.col("at_us")))
    w = Window.partitionBy(key).orderBy("at_us", "event_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = at.withColumn("next_us", F.min("answer_us").over(w))
    return nxt.where(opened).where(F.col("next_us").isNull() | (F.col("next_us") - F.col("at_us") > span_us)).select("event_id", key, "at_us")
