"""Arrow-batch helpers: one function per batch of columns, with no row objects in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict[str, pa.Array]], dict[str, list | pa.Array]]], schema: str | StructType) -> DataFrame:
    """mapInArrow over named columns.

    make() runs once per task and returns the batch function, so tables it needs are built once; the batch function takes the
    input columns by position-stable name and returns the output columns by name.
    """
    spark_schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(spark_schema)
    names = [f.name for f in arrow_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = step({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            columns = [_cast(out[n], arrow_schema.field(n).type) for n in names]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return df.mapInArrow(run, spark_schema)


def _cast(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
