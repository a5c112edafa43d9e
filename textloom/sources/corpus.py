"""Readers of written corpora; missing or damaged state is empty state."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import STATE

MANIFEST = "source_id string, source_path string, source_version_id string, output_path string, title string, parser string, sha256 string, size_bytes long, mime_type string, chunk_count long"
CHUNKS = "chunk_id string, source_id string, source_path string, ordinal long, section_path array<string>, text string, char_count long, approx_tokens long, sha256 string"
NODES = "id string, type string, source_path string, title string, sha256 string, source_id string, ordinal long, section_path array<string>, url string"
EDGES = "id string, source string, target string, type string"
ERRORS = "source_path string, stage string, error_type string, message string, sha256 string"
SCHEMAS = {"manifest": MANIFEST, "chunks": CHUNKS, "nodes": NODES, "edges": EDGES, "errors": ERRORS}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).json(f"{root}/{name}.jsonl")


STATE_COLUMNS = [f.strip().split(" ")[0] for f in STATE.split(",")]


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """State of an older layout counts as none; a repeated or unnamed source as not seen."""
    path = Path(root, "_state", "files.parquet")
    if (path / "_SUCCESS").exists():
        try:
            got = spark.read.parquet(str(path))
            if set(STATE_COLUMNS) <= set(got.columns):
                return got.select(STATE_COLUMNS).where("source_path is not null and markdown is not null").dropDuplicates(["source_path"])
        except Exception:  # noqa: BLE001  damaged state: convert all
            pass
    return spark.createDataFrame([], STATE)


def published(state: DataFrame, root: Path) -> DataFrame:
    """output_path, document_sha256 of the documents of a state as they stand on disk; null where one is gone."""
    top = str(root)

    def digest(output: str) -> str | None:
        try:
            with Path(top, output).open("rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()
        except OSError:
            return None

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([digest(n) for n in names], pa.string())], names=["output_path", "document_sha256"])

    return state.select("output_path").mapInArrow(run, "output_path string, document_sha256 string")
