"""Conversion of (source_path, content) rows, isolated: a failure is a row with an error, never a failed task."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import converters

OUT = "source_path string, status string, markdown string, parser string, title string, extraction string, error_type string, message string"


def convert(files: DataFrame, registry=None, keep: Sequence[str] = ()) -> DataFrame:
    """OUT for each row of files (source_path, content), beside its columns `keep`. status: converted, unsupported or failed. registry: Converters that take part."""
    carried = [f for f in files.schema if f.name in keep]
    schema = T.StructType([*carried, *T._parse_datatype_string(OUT)])
    arrow = to_arrow_schema(schema)

    def one(path: str, data: bytes):
        name = PurePosixPath(path.rsplit("!/", 1)[-1]).name
        try:
            r = converters.convert(data or b"", name, registry)
            return path, "converted", r.markdown.rstrip() + "\n", r.parser, r.title or PurePosixPath(name).stem, json.dumps(r.meta, ensure_ascii=False, sort_keys=True), None, None
        except converters.Unsupported as e:
            return path, "unsupported", None, None, None, None, "UnsupportedFormat", str(e)
        except Exception as e:  # noqa: BLE001  failures are data
            return path, "failed", None, None, None, None, type(e).__name__, str(e)

    def run(batches):
        rows, held = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for at in range(batch.num_rows):  # a file at a time: the largest file bounds memory
                *own, path, data = (c.slice(at, 1).to_pylist()[0] for c in batch.columns)
                rows.append((*own, *one(path, data)))
                held += len(rows[-1][len(own) + 2] or "")
                if len(rows) >= 256 or held > 4 << 20:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    return files.select(*(f.name for f in carried), "source_path", "content").mapInArrow(run, schema)


def capabilities(spark: SparkSession, registry=None) -> DataFrame:
    """name, extensions, needs (an optional library), available."""
    rows = [(c.name, ",".join(sorted(c.extensions)), c.needs, c.available()) for c in registry or converters.REGISTRY]
    return spark.createDataFrame(rows, "name string, extensions string, needs string, available boolean")
