"""Documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, near_copies, packing, pii, quality
from textloom.llm.common import drop_tables, materialize, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged as an empty passage; equal rows fare alike; all columns come back, whatever their names; an
    empty table stays empty. Where no labels of both kinds are given nothing is rejected.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id (near_copies.keep_first says what nulls and repeats mean).

    SimHash with pivot distance tables; what they leave is joined where 5-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return near_copies.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none; equal rows fare alike; all columns come back, whatever their names; an empty table of
    documents stays empty, an empty benchmark lets all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind.

    Every row stays; a null text stays null; n_chars follows the new text; all other columns come back, whatever their names.
    """
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a training sequence.

    Null and empty texts are one piece, END alone; equal rows and equal or null ids are documents of their own; other columns,
    whatever their names, are not read; an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: The stages can't be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of what is written on the way only these stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            before, docs = docs, keep(materialize(stage(spark, docs, sf_dir)))
        drop_tables(before)
    return docs
