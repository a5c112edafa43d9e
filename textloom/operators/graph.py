"""The structural graph: document, chunk and url nodes; contains, next, references_url and links_to edges. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import folder, stable_id, unquote

LINK = r"\[[^\]]*\]\(([^)]+)\)"
URL = r"""https?://[^\s<>()\[\]{}"']+"""


def links(markdown) -> Column:
    """Targets of Markdown links, in order, without blanks and angle brackets around them."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), "^[<>]+|[<>]+$", ""))


def bare_urls(markdown) -> Column:
    return F.regexp_extract_all(markdown, F.lit(URL), F.lit(0))


def is_url(link: Column) -> Column:
    """http and https links that parse; a bad bracketed host is none."""
    return link.rlike("(?i)^https?:") & ~link.rlike(r"^[A-Za-z]+://(?:[^/\[]*\[[^\]/]*(?:/|$)|\[(?![0-9A-Fa-f:.vV]*\]))")


def urls(markdown) -> Column:
    return F.array_distinct(F.concat(bare_urls(markdown), F.filter(links(markdown), is_url)))


def edge(source, target, kind: str) -> list[Column]:
    return [stable_id("edge", source, target, F.lit(kind)).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type")]


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """contains and next edges, from one pass over the chunks."""
    rows = chunks.select("source_id", "chunk_id", F.lead("chunk_id").over(Window.partitionBy("source_id").orderBy("ordinal")).alias("then"))
    both = F.array(F.struct(*edge(F.col("source_id"), F.col("chunk_id"), "contains")), F.when(F.col("then").isNotNull(), F.struct(*edge(F.col("chunk_id"), F.col("then"), "next"))))
    return rows.select(F.explode(F.array_compact(both)).alias("e")).select("e.*")


def contains(chunks: DataFrame) -> DataFrame:
    return chunk_edges(chunks).where("type = 'contains'")


def following(chunks: DataFrame) -> DataFrame:
    return chunk_edges(chunks).where("type = 'next'")


def references(docs: DataFrame) -> DataFrame:
    return docs.select("source_id", F.explode(urls("markdown")).alias("url")).select(*edge(F.col("source_id"), stable_id("url", "url"), "references_url"))


def local_target(source_path: Column, link: Column) -> Column:
    """The path that a relative link names, . and .. resolved; null for links with a scheme, fragments and absolute paths."""
    path = F.regexp_replace(link, r"(?s)[?#].*$", "")
    joined = F.concat(folder(source_path), F.lit("/"), unquote(path))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("#") | path.startswith("/"), F.lit(None)).otherwise(F.array_join(done, "/"))


def local_links(docs: DataFrame) -> DataFrame:
    """One edge for each occurrence of a link to a document; only paths and links are shuffled, never texts."""
    out = docs.select("source_id", "source_path", F.explode(links("markdown")).alias("link")).select("source_id", local_target(F.col("source_path"), F.col("link")).alias("path")).where("path is not null")
    known = docs.select(F.col("source_path").alias("path"), F.col("source_id").alias("target"))
    return out.join(known, "path").select(*edge(F.col("source_id"), F.col("target"), "links_to"))


def edges(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunk_edges(chunks).unionByName(references(docs)).unionByName(local_links(docs))


def document_nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source_id").alias("id"), F.lit("document").alias("type"), "source_path", "title", "sha256")


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), "source_id", "source_path", "ordinal", "section_path", "sha256")


def url_nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(urls("markdown")).alias("url")).distinct().select(stable_id("url", "url").alias("id"), F.lit("url").alias("type"), "url")


def nodes(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return document_nodes(docs).unionByName(chunk_nodes(chunks), allowMissingColumns=True).unionByName(url_nodes(docs), allowMissingColumns=True)
