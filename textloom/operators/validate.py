"""Integrity checks of a corpus: (check, violations). Each table is read once or twice, whatever the number of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import index_line
from . import incremental

EDGE_TYPES = ("contains", "next", "references_url", "links_to")


def _if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")


def _rows(one: DataFrame) -> DataFrame:
    """A row (check, violations) for each column of a one-row table."""
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in one.columns))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def _sources(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks summed up by source, beside the manifest."""
    shape = (F.col("char_count") != F.length("text")) | (F.trim("text") == "") | (F.col("approx_tokens") != F.greatest(F.lit(1), F.floor((F.length("text") + 3) / 4)))
    own = chunks.groupBy("source_id").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"), _if(F.coalesce(shape, F.lit(True))).alias("odd"),
        _if(F.coalesce(F.col("sha256") != F.sha2("text", 256), F.lit(True))).alias("digest"), F.min("source_path").alias("p0"), F.max("source_path").alias("p1"),
    )
    told = manifest.groupBy("source_id").agg(F.first("source_path").alias("path"), F.max("chunk_count").alias("told"))
    both = told.join(own, "source_id", "full")
    return both.agg(
        _if(F.col("told").isNull()).alias("orphan_chunks"), _if((F.col("p0") != F.col("path")) | (F.col("p1") != F.col("path"))).alias("chunk_paths"), F.coalesce(F.sum("odd"), F.lit(0)).alias("chunk_shape"), F.coalesce(F.sum("digest"), F.lit(0)).alias("chunk_digest"),
        _if((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))).alias("dense_ordinals"), _if(F.col("told") != F.coalesce("n", F.lit(0))).alias("chunk_counts"),
    )


def _identities(manifest: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every id of every table, once each, summed up by id."""
    roles = ["source", "chunk", "node", "document", "from_edge", "to_edge", "contains", "odd"]

    def said(df: DataFrame, value, **counts) -> DataFrame:
        return df.select(value.alias("id"), *(counts.get(r, F.lit(0)).cast("long").alias(r) for r in roles))

    one = F.lit(1)
    kind = [(F.col("type") == "contains").cast("int").alias("c"), (~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False))).cast("int").alias("o")]
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("f"), F.lit(0).alias("t"), *kind), F.struct(F.col("target").alias("id"), F.lit(0).alias("f"), F.lit(1).alias("t"), F.lit(0).alias("c"), F.lit(0).alias("o"))))
    rows = said(manifest, F.col("source_id"), source=one).union(said(chunks, F.col("chunk_id"), chunk=one)).union(said(nodes, F.col("id"), node=one, document=(F.col("type") == "document").cast("int")))
    rows = rows.union(said(edges.select(ends.alias("e")), F.col("e.id"), from_edge=F.col("e.f"), to_edge=F.col("e.t"), contains=F.col("e.c"), odd=F.col("e.o")))
    by = rows.groupBy("id").agg(*(F.sum(r).alias(r) for r in roles))
    return by.agg(
        _if(F.col("source") > 1).alias("unique_source_id"), _if(F.col("chunk") > 1).alias("unique_chunk_id"), _if(F.col("node") > 1).alias("unique_node_id"), _if((F.col("from_edge") > 0) & (F.col("node") == 0)).alias("dangling_source"), _if((F.col("to_edge") > 0) & (F.col("node") == 0)).alias("dangling_target"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("edge_types"), F.abs(F.coalesce(F.sum(F.col("contains") - F.col("chunk")), F.lit(0))).alias("contains_count"), _if((F.col("document") > 0) != (F.col("source") > 0)).alias("document_nodes"), _if((F.col("chunk") > 0) & (F.col("node") == 0)).alias("chunk_nodes"),
    )


def _names(manifest: DataFrame) -> DataFrame:
    named = F.explode(F.array(F.struct(F.lit("source_path").alias("k"), F.col("source_path").alias("v")), F.struct(F.lit("output_path").alias("k"), F.col("output_path").alias("v"))))
    by = manifest.select(named.alias("x"), F.coalesce(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(True)).alias("bad")).groupBy("x").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    return by.agg(_if((F.col("x.k") == "source_path") & (F.col("n") > 1)).alias("unique_source_path"), _if((F.col("x.k") == "output_path") & (F.col("n") > 1)).alias("unique_output_path"), F.coalesce(F.sum(F.when(F.col("x.k") == "source_path", F.col("bad"))), F.lit(0)).alias("digest_shape"))


def validate(manifest: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """check, violations."""
    return _rows(_sources(manifest, chunks)).union(_rows(_identities(manifest, chunks, nodes, edges))).union(_rows(_names(manifest)))


def validate_files(spark: SparkSession, root: str, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """check, violations of the documents and the index as they stand: front matter, presence both ways, index lines, chunks in bodies."""
    top = F.regexp_extract("path", r"(documents/.*)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/documents").select(top.alias("output_path"), F.decode("content", "UTF-8").alias("text"))
    both = manifest.join(files.withColumn("there", F.lit(True)), "output_path", "left")
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(F.col(v).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    agree = F.lit(True)
    for name in ("source_id", "sha256", "parser"):
        agree = agree & F.contains(front, F.concat(F.lit(f"\n{name}: "), quoted(name)))
    missing = F.col("there").isNull()
    one = both.agg(_if(missing).alias("documents_missing"), _if(~missing & ~agree).alias("front_matter"))
    extra = incremental.orphans(files, manifest).agg(F.count("*").alias("documents_unknown"))
    index = spark.read.text(f"{root}/INDEX.md").where("value like '- [%'").groupBy("value").agg(F.count("*").alias("n"))
    want = manifest.select(index_line("source_path", "output_path", "parser", "chunk_count").alias("value"), F.lit(1).alias("want"))
    lines = index.join(want, "value", "full").agg(_if(F.coalesce("n", F.lit(0)) != F.coalesce("want", F.lit(0))).alias("index_lines"))
    bare = lambda t: F.regexp_replace(t, r"\s+", " ")
    body = manifest.join(files, "output_path").select("source_id", bare("text").alias("body"))
    parts = chunks.select("source_id", F.explode(F.split("text", r"\n\n")).alias("part")).join(body, "source_id")  # a merged chunk holds two windows: its paragraphs stand, not always side by side
    inside = parts.agg(_if(~F.contains("body", F.trim(bare("part")))).alias("chunk_in_body"))
    return _rows(one).union(_rows(extra)).union(_rows(lines)).union(_rows(inside))
