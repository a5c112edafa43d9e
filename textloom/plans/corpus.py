"""A corpus run: files to Markdown documents, manifest, chunks, graph and errors, published all at once."""

from __future__ import annotations

import functools
import hashlib
import os
import shutil
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.columns import extension, front_matter, index_line, sorted_json, stable_id
from ..operators import chunking, convert, graph, incremental, paths
from ..settings import VERSION, Settings
from ..sources import archives, corpus, walk


@contextmanager
def locked(out: Path):
    """One writer at a time; a lock that a dead run left is removed by hand."""
    (out / "_state").mkdir(parents=True, exist_ok=True)
    lock = out / "_state" / "lock"
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"another run writes to {out}; remove {lock} if none does") from None
    os.write(handle, f"pid {os.getpid()}\n".encode())
    os.close(handle)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def guard(source: Path, out: Path) -> None:
    source, out = source.resolve(), out.resolve()
    if not source.exists():
        raise FileNotFoundError(source)
    if out == source or out in source.parents:
        raise ValueError("the output folder must not be, or contain, the source")


def _failure(rows: DataFrame, stage: str, kind, message, sha256=None) -> DataFrame:
    """Rows of corpus.ERRORS."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("source_path", F.lit(stage).alias("stage"), text(kind).alias("error_type"), text(message).alias("message"), (F.lit(None) if sha256 is None else sha256).cast("string").alias("sha256"))


def _gather(spark: SparkSession, files: DataFrame, settings: Settings, stage: Path, errors: list[DataFrame]) -> DataFrame:
    """All sources, archive members among them (breadth first), as a written table."""
    cap = settings.max_file_mb << 20
    errors.append(_failure(files.where("error_type is not null"), "discover", F.col("error_type"), F.col("message")))
    good = files.where("error_type is null")
    errors.append(_failure(good.where(F.col("size_bytes") > cap), "limits", "FileTooLarge", f"File exceeds {settings.max_file_mb} MiB"))
    walk.read(good.where(F.col("size_bytes") <= cap)).write.parquet(str(stage / "read"))
    got = spark.read.parquet(str(stage / "read"))
    errors.append(_failure(got.where("error_type is not null"), "read", F.col("error_type"), F.col("message")))
    level = got.where("error_type is null").select("source_path", F.lit(0).alias("round"), "place", "size_bytes", "content")
    parts = []
    for depth in range(settings.archive_depth + 1):
        packed = archives.is_archive(F.col("source_path"))
        parts.append(level.where(~packed))
        boxes = level.where(packed)
        if boxes.isEmpty():
            break
        if depth == settings.archive_depth:
            errors.append(_failure(boxes, "archive", "ArchiveDepthExceeded", f"Archives are nested more than {depth} deep", F.sha2("content", 256)))
            break
        archives.expand(boxes, settings).write.parquet(str(stage / f"members{depth}"))
        got = spark.read.parquet(str(stage / f"members{depth}"))
        digests = boxes.select(F.col("source_path").alias("archive"), F.sha2("content", 256).alias("sha256"))
        named = lambda df: df.join(digests, "archive").withColumnRenamed("archive", "source_path")  # noqa: E731, B023
        errors.append(_failure(named(got.where("error_type is not null").select("archive", "error_type", "message")), "archive", F.col("error_type"), F.col("message"), F.col("sha256")))
        whole = archives.whole(got)
        budget = paths.over_budget(whole, settings.archive_max_files, settings.archive_max_expanded_mb << 20)
        errors.append(_failure(named(budget.where("over").select("archive")), "archive", "ArchiveBudgetExceeded", "The run's archive budget is spent", F.col("sha256")))
        rows = whole.join(budget.where("not over").select("archive"), "archive", "left_semi").select(F.concat("archive", F.lit("!/"), "member").alias("source_path"), F.lit(depth + 1).alias("round"), F.concat("place", F.lit("\1"), F.lpad(F.col("member_no").cast("string"), 9, "0")).alias("place"), F.col("size").alias("size_bytes"), "content")
        errors.append(_failure(rows.where(F.col("size_bytes") > cap), "limits", "FileTooLarge", f"File exceeds {settings.max_file_mb} MiB"))
        level = rows.where(F.col("size_bytes") <= cap)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def described(sources: DataFrame) -> DataFrame:
    """source_path and its identities: source_id, source_version_id, sha256, mime_type, extension."""
    named = sources.withColumn("source_name", F.substring_index(F.substring_index("source_path", "!/", -1), "/", -1)).withColumn("source_extension", extension("source_name"))
    return named.withColumns({"sha256": F.sha2("content", 256), "source_id": stable_id("src", "source_path"), "mime_type": mime.mime_type(F.col("source_extension"))}).withColumn("source_version_id", stable_id("ver", "source_path", "sha256"))


def document_text(docs: DataFrame) -> DataFrame:
    names = ["source_id", "source_path", "source_version_id", "source_name", "source_extension", "mime_type"]
    fields = [("engine", F.lit(VERSION), True), *((n, F.col(n), True) for n in names), ("size_bytes", F.col("size_bytes"), False), ("sha256", F.col("sha256"), True), ("parser", F.col("parser"), True), ("title", F.col("title"), True), ("extraction", F.col("extraction"), False)]
    return docs.withColumn("document", F.concat(front_matter(fields), "markdown"))


def _jsonl(df: DataFrame, path: Path, order: list) -> None:
    """One sorted file, keys sorted, streamed through the driver partition by partition."""
    rows = df.orderBy(*order).select(sorted_json(path.name != "nodes.jsonl", **{c: c for c in df.columns}).alias("j"))
    with path.open("w", encoding="utf-8", newline="\n") as f:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write(r.j + "\n")


def recover(out: Path) -> None:
    """A publication that died on the way left the only copies of what it replaced: they return before anything else is done."""
    old = out / "_state" / "previous"
    if not old.exists():
        return
    for back in sorted(old.iterdir()):
        to = out / back.name if back.name != "files.parquet" else out / "_state" / back.name
        if to.is_dir():
            shutil.rmtree(to)
        os.replace(back, to)
    old.rmdir()


def publish(staged: Path, out: Path) -> None:
    """Moves all staged names into place, or none: on failure the old ones return."""
    old = out / "_state" / "previous"
    old.mkdir(parents=True)  # recover() has seen to an older one
    moved = []
    try:
        for p in sorted(staged.iterdir()):
            to = out / p.name if p.name != "files.parquet" else out / "_state" / p.name
            if to.exists():
                os.replace(to, old / p.name)
                moved.append((to, old / p.name))
            else:
                moved.append((to, None))
            os.replace(p, to)
    except BaseException:
        for to, back in reversed(moved):
            if to.is_dir():
                shutil.rmtree(to)
            else:
                to.unlink(missing_ok=True)
            if back and back.exists():
                os.replace(back, to)
        old.rmdir()
        raise
    shutil.rmtree(old, ignore_errors=True)


def run(spark: SparkSession, source: str, out: str, settings: Settings = Settings(), registry=None) -> dict:
    """Converts a file or a tree into a corpus under `out` and returns the counters."""
    settings.validate()
    src, root = Path(source), Path(out)
    guard(src, root)
    root.mkdir(parents=True, exist_ok=True)
    with locked(root):
        recover(root)
        stage, ready = root / "_state" / "stage", root / "_state" / "ready"
        for d in (stage, ready):
            shutil.rmtree(d, ignore_errors=True)
            d.mkdir(parents=True)
        try:
            return _run(spark, src, root, settings, registry, stage, ready)
        finally:
            shutil.rmtree(stage, ignore_errors=True)
            shutil.rmtree(ready, ignore_errors=True)


def _run(spark, src: Path, root: Path, settings: Settings, registry, stage: Path, ready: Path) -> dict:
    state, conf = corpus.read_state(spark, str(root)), settings.digest()
    if src.is_file() and (root / "manifest.jsonl").exists() and not incremental.outside(corpus.read(spark, str(root), "manifest"), src.name).isEmpty():
        raise ValueError("a run over one file would drop the other sources of this corpus")
    walk.listing(spark, src, settings.include_hidden, root).write.parquet(str(stage / "listing"))
    files = spark.read.parquet(str(stage / "listing"))
    errors: list[DataFrame] = []
    sources = described(_gather(spark, files, settings, stage, errors))
    named = paths.claims(sources.select("source_path", F.struct("round", "place").alias("place")))
    sources = sources.join(named, "source_path")
    errors.append(_failure(sources.where("clash"), "output", "OutputNameTaken", "The output name is taken"))
    sources = sources.where("not clash").drop("clash")
    if settings.incremental:
        seen = sources.select("source_path", "sha256", "output_path")
        skip = incremental.plan(seen, state, conf, corpus.published(state, root)).where("action = 'skip'").select("source_path")
        old = state.join(skip, "source_path").select("source_path", *(F.col(c).alias(f"old_{c}") for c in ("title", "parser", "markdown", "extraction")))
        sources = sources.join(old, "source_path", "left")
    else:
        sources = sources.withColumns({c: F.lit(None).cast("string") for c in ("old_title", "old_parser", "old_markdown", "old_extraction")})
    named = [c for c in sources.columns if c not in ("content", "source_path") and not c.startswith("old_")]
    convert.convert(sources.where("old_markdown is null"), registry, named).write.parquet(str(stage / "converted"))
    fresh = spark.read.parquet(str(stage / "converted"))
    errors.append(_failure(fresh.where("status <> 'converted'"), "convert", F.col("error_type"), F.col("message"), F.col("sha256")))
    kept = sources.where("old_markdown is not null").select("source_path", *named, F.lit("skipped").alias("status"), *(F.col(f"old_{c}").alias(c) for c in ("markdown", "parser", "title", "extraction")))
    document_text(fresh.where("status = 'converted'").drop("error_type", "message").unionByName(kept)).write.parquet(str(stage / "documents"))
    docs = spark.read.parquet(str(stage / "documents"))
    _documents(docs.select("source_path", "output_path", "document"), ready).write.parquet(str(stage / "written"))
    written = spark.read.parquet(str(stage / "written"))
    errors.append(_failure(written.where("error_type is not null"), "write", F.col("error_type"), F.col("message")))
    docs = docs.join(written.where("error_type is null").select("source_path", "document_sha256"), "source_path")
    chunking.chunk_table(docs, settings).write.parquet(str(stage / "chunks"))
    chunks = spark.read.parquet(str(stage / "chunks"))
    failed = functools.reduce(DataFrame.unionByName, errors).dropDuplicates(["source_path", "stage"]).cache()
    if settings.strict and (first := failed.orderBy("source_path").first()):
        raise RuntimeError(f"{first.source_path}: {first.error_type}: {first.message}")
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    manifest = docs.join(counts, "source_id", "left").select("source_id", "source_path", "source_version_id", "output_path", "title", "parser", "sha256", "size_bytes", "mime_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "status").cache()
    outcomes = manifest.select("status", F.lit(False).alias("top"), F.col("chunk_count").alias("chunks"))
    outcomes = outcomes.union(failed.select(F.when(F.col("error_type") == "UnsupportedFormat", "unsupported").otherwise("failed"), F.lit(False), F.lit(0))).union(files.select(F.lit("listed"), F.lit(True), F.lit(0)))
    stats = incremental.stats(outcomes).first().asDict()
    manifest, kept_rows = manifest.drop("status"), manifest
    _jsonl(manifest, ready / "manifest.jsonl", [F.lower("source_path"), "source_path"])
    _jsonl(chunks, ready / "chunks.jsonl", [F.lower("source_path"), "source_path", "ordinal"])
    _jsonl(graph.nodes(docs, chunks), ready / "nodes.jsonl", ["id"])
    _jsonl(graph.edges(docs, chunks), ready / "edges.jsonl", ["id"])
    _jsonl(failed, ready / "errors.jsonl", ["source_path", "stage"])
    docs.select(F.lit(conf).alias("config_hash"), *(c for c in corpus.STATE_COLUMNS if c != "config_hash")).write.parquet(str(ready / "files.parquet"))
    _reports(manifest, failed, stats, ready)
    publish(ready, root)
    failed.unpersist()
    kept_rows.unpersist()
    return stats


def _documents(docs: DataFrame, ready: Path) -> DataFrame:
    """source_path, document_sha256, error_type, message: executors write a Markdown file for each document in the shared staging folder.

    A file appears whole or not at all, so a task that runs again does no harm; one that can't be written is a row with an error.
    """
    top = str(ready)
    (ready / "documents").mkdir(exist_ok=True)

    def one(source: str, output: str, text: str):
        data = text.encode("utf-8", "surrogatepass")
        try:
            p = Path(top, output)
            if ".." in p.parts:
                raise ValueError(f"unsafe output path {output}")
            p.parent.mkdir(parents=True, exist_ok=True)
            part = p.with_name(f".{uuid.uuid4().hex}.part")
            part.write_bytes(data)
            os.replace(part, p)
        except (OSError, ValueError) as e:
            return source, None, type(e).__name__, str(e)
        return source, hashlib.sha256(data).hexdigest(), None, None

    def run(batches):
        for b in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["source_path", "document_sha256", "error_type", "message"])

    return docs.mapInArrow(run, "source_path string, document_sha256 string, error_type string, message string")


def _reports(manifest: DataFrame, failed: DataFrame, stats: dict, ready: Path) -> None:
    with (ready / "INDEX.md").open("w", encoding="utf-8", newline="\n") as f:
        f.write(f"# Corpus index\n\nDocuments: {stats['converted'] + stats['skipped']}\n\n")
        for r in manifest.orderBy(F.lower("source_path"), "source_path").select(index_line("source_path", "output_path", "parser", "chunk_count").alias("l")).toLocalIterator():
            f.write(r.l + "\n")
    with (ready / "REPORT.md").open("w", encoding="utf-8", newline="\n") as f:
        f.write("# Conversion report\n\n" + "".join(f"- {k.capitalize()}: **{v}**\n" for k, v in stats.items()) + "\n")
        rows = failed.orderBy("source_path", "stage").toLocalIterator()
        f.writelines(["## Errors\n\n"] if stats["failed"] or stats["unsupported"] else ["No conversion errors.\n"])
        f.writelines(f"- `{r.source_path}` — **{r.error_type}**: {r.message}\n" for r in rows)
