"""Change detection against stored state, and what a run leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "source_path string, sha256 string, config_hash string, output_path string, source_id string, title string, parser string, document_sha256 string, markdown string, extraction string"


def plan(sources: DataFrame, state: DataFrame, config_hash: str, published: DataFrame | None = None) -> DataFrame:
    """source_path, action: new and deleted by presence; else skip where digest, settings and output name agree, changed where not.

    published (output_path, document_sha256): the documents as they stand; one that is gone or another is tampered.
    """
    s = state.select("source_path", F.col("sha256").alias("old"), F.col("config_hash").alias("conf"), F.col("output_path").alias("old_output"), *(["document_sha256"] if published is not None else []), F.lit(True).alias("there"))
    intact = F.lit(True)
    if published is not None:
        s = s.join(published.select(F.col("output_path").alias("old_output"), F.col("document_sha256").alias("on_disk")), "old_output", "left")
        intact = F.coalesce(F.col("document_sha256") == F.col("on_disk"), F.lit(False))
    both = sources.select("source_path", "sha256", "output_path", F.lit(True).alias("here")).join(s, "source_path", "full")
    same = (F.col("sha256") == F.col("old")) & (F.col("conf") == config_hash) & (F.col("output_path") == F.col("old_output"))
    action = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "new").when(~F.coalesce(same, F.lit(False)), "changed").when(intact, "skip").otherwise("tampered")
    return both.select("source_path", action.alias("action"))


def orphans(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Output files that no document of the manifest owns."""
    return outputs.join(manifest.select("output_path"), "output_path", "left_anti")


def outside(manifest: DataFrame, path: str) -> DataFrame:
    """Manifest rows that a run over one file would lose."""
    return manifest.where((F.col("source_path") != path) & ~F.col("source_path").startswith(path + "!/"))


def stats(outcomes: DataFrame) -> DataFrame:
    """One row of counters of (status, top, chunks)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.agg(F.count_if("top").alias("discovered"), n("converted"), n("skipped"), n("unsupported"), n("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))
