"""Continuous ingest: new files of a folder, in micro-batches, converted and chunked into tables, failures in a table of their own.

A source's name is its path below the folder, so that equal names in two subfolders stay apart. The stream sees each path once;
sources that change or go need a batch run, whose state join finds them. Archives are not opened here: a batch run does that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..operators import chunking, convert
from ..settings import Settings


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = Settings(), pattern: str = "*"):
    """Starts the query; it ends when all present files are in. A batch that runs again overwrites its own part only.

    Tables under out: documents, chunks and errors (source_path, stage, error_type, message).
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    cap = settings.max_file_mb << 20

    def batch(df: DataFrame, n: int) -> None:
        path = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
        rows = df.select(F.substring(path, F.lit(len(top) + 1), F.length(path)).alias("source_path"), "length", "content")
        convert.convert(rows.where(F.col("length") <= cap)).write.mode("overwrite").parquet(f"{out}/converted/batch={n}")
        got = spark.read.parquet(f"{out}/converted/batch={n}")
        large = rows.where(F.col("length") > cap).select("source_path", F.lit("limits").alias("stage"), F.lit("FileTooLarge").alias("error_type"), F.lit(f"File exceeds {settings.max_file_mb} MiB").alias("message"))
        large.union(got.where("status <> 'converted'").select("source_path", F.lit("convert"), "error_type", "message")).write.mode("overwrite").parquet(f"{out}/errors/batch={n}")
        docs = got.where("status = 'converted'").drop("error_type", "message").withColumn("source_id", stable_id("src", "source_path"))
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={n}")
        chunking.chunk_table(spark.read.parquet(f"{out}/documents/batch={n}"), settings).write.mode("overwrite").parquet(f"{out}/chunks/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
