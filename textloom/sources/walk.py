"""File trees as DataFrames: the driver lists the top, executors list each folder below it and read the bytes."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

FILES = "source_path string, full string, size_bytes long, place string, error_type string, message string"


def _file(root: Path, p: Path, include_hidden: bool):
    """A row of FILES, or None for what the walk leaves out. A file that can't be looked at is a row with an error."""
    rel = p.relative_to(root).as_posix()
    if not rules.discovered(rel, include_hidden):
        return None
    try:
        if p.is_symlink() or not p.is_file():
            return None
        return rel, str(p), p.stat().st_size, rules.order_key(rel), None, None
    except OSError as e:
        return rel, str(p), 0, rules.order_key(rel), type(e).__name__, str(e)


def _below(root: Path, top: Path, include_hidden: bool, leave: str):
    """Rows of all files under a folder; links are not followed, and a folder that can't be read is a row with an error."""
    refused: list[OSError] = []
    for here, dirs, names in os.walk(top, onerror=refused.append):
        dirs[:] = [d for d in dirs if rules.enters(d, include_hidden) and not os.path.islink(os.path.join(here, d)) and os.path.realpath(os.path.join(here, d)) != leave]
        yield from filter(None, (_file(root, Path(here, n), include_hidden) for n in names))
    for e in refused:
        rel = Path(e.filename).relative_to(root).as_posix()
        yield rel, e.filename, 0, rules.order_key(rel), type(e).__name__, str(e)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["source_path", "full", "size_bytes", "place", "error_type", "message"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def listing(spark: SparkSession, root: Path, include_hidden: bool = False, leave: Path | None = None) -> DataFrame:
    """FILES under root. place sorts them in processing order. A single file passes no filter; the folder `leave` is left out."""
    root, keep_out = Path(root), os.path.realpath(leave) if leave else ""
    if root.is_file():
        return spark.createDataFrame([(root.name, str(root), root.stat().st_size, rules.order_key(root.name), None, None)], FILES)
    here = sorted(os.scandir(root), key=lambda e: e.name)
    folders = [e.path for e in here if e.is_dir(follow_symlinks=False) and rules.enters(e.name, include_hidden) and os.path.realpath(e.path) != keep_out]
    own = [r for e in here if not e.is_dir(follow_symlinks=False) and (r := _file(root, Path(e.path), include_hidden))]
    top = spark.createDataFrame(own, FILES)

    def run(batches):
        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                for r in _below(root, Path(folder), include_hidden, keep_out):
                    rows.append(r)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    if not folders:
        return top
    return top.union(spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders)).mapInArrow(run, FILES))


def read(files: DataFrame, per_task: int = 64 << 20) -> DataFrame:
    """source_path, place, size_bytes, content, error_type, message of rows of FILES. Tasks get about per_task bytes each.

    A file that can't be read, or has another size than when it was listed, is a row with an error and no content.
    """
    spark = files.sparkSession
    total, count = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    n = max(1, min(count, max(spark.sparkContext.defaultParallelism, total // per_task + 1)))

    def one(path: str, full: str, size: int, place: str):
        try:
            data = Path(full).read_bytes()
        except OSError as e:
            return path, place, size, None, type(e).__name__, str(e)
        if len(data) != size:
            return path, place, size, None, "SourceChangedDuringRead", f"{size} bytes when listed, {len(data)} when read"
        return path, place, size, data, None, None

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one(*row), kinds)], names=["source_path", "place", "size_bytes", "content", "error_type", "message"])

    return files.select("source_path", "full", "size_bytes", "place").repartition(n).mapInArrow(run, "source_path string, place string, size_bytes long, content binary, error_type string, message string")
