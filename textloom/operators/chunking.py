"""Heading-aware overlapping chunks. The cursor of a document can't be cut up, so a row is the unit of work; ids are native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import approx_tokens, stable_id
from ..settings import Settings
from .batches import map_batches

PIECES = "source_id string, source_path string, ordinal long, section_path array<string>, text string"


def split(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """PIECES of docs (source_id, source_path, markdown); null Markdown is empty and gives none."""
    settings.validate()
    a, b, c = settings.chunk_chars, settings.overlap_chars, settings.min_chunk_chars

    def pieces(*columns):
        out = [(i, p, k, [*path], text) for i, p, md in zip(*columns) for k, (path, text) in enumerate(rules.chunks(md or "", a, b, c))]
        return zip(*out) if out else [[]] * 5

    return map_batches(docs.select("source_id", "source_path", "markdown"), pieces, PIECES)


def chunk_table(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    digest = F.sha2("text", 256)
    return split(docs, settings).select(
        stable_id("chk", "source_id", F.array_join("section_path", "/"), "ordinal", digest).alias("chunk_id"), "source_id", "source_path", "ordinal", "section_path", "text",
        F.length("text").cast("long").alias("char_count"), approx_tokens("text").alias("approx_tokens"), digest.alias("sha256"),
    )


def section_table(docs: DataFrame) -> DataFrame:
    """source_id, section (from 0), section_path, text: the sections that split() cuts into windows."""

    def parts(*columns):
        out = [(i, k, [*path], text) for i, md in zip(*columns) for k, (path, text) in enumerate(rules.sections(md or ""))]
        return zip(*out) if out else [[]] * 4

    return map_batches(docs.select("source_id", "markdown"), parts, "source_id string, section long, section_path array<string>, text string")
