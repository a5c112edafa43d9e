"""Arrow batch maps in bounded memory: a function gets a few of a batch's rows at a time."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that one call of a batch function gets at most (one row at least); they bound a Python worker's memory.
ROWS_PER_CALL, BYTES_PER_CALL = 1024, 8 << 20


def calls(sizes) -> list[tuple[int, int]]:
    """Ranges of rows of these sizes in bytes, each within ROWS_PER_CALL and BYTES_PER_CALL or of one row."""
    out, at, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > at and (k - at >= ROWS_PER_CALL or held + n > BYTES_PER_CALL):
            out.append((at, k))
            at, held = k, 0
        held += n
    return [*out, (at, len(sizes))] if len(sizes) else []


def row_bytes(batch: pa.RecordBatch) -> list[int]:
    total = pa.array([0] * batch.num_rows, pa.int64())
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            total = pc.add(total, pc.fill_null(pc.binary_length(c).cast(pa.int64()), 0))
    return total.to_pylist()


def map_batches(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """Applies fn(*columns as Python lists) -> list of columns to Arrow batches of df, as many rows a call as calls() allows."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for a, b in calls(row_bytes(whole)):
                part = whole.slice(a, b - a)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
