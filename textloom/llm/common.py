"""What the operators of this subpackage share: texts and samples, and by name the batch maps and written tables that all operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import BYTES_PER_CALL, ROWS_PER_CALL, calls, map_batches  # noqa: F401
from ..operators.tables import drop_tables, materialize, scratch, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; extra columns, whatever their names, stay behind. Null texts are empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def sample_cut(rows: int, bound: int) -> int:
    """Hashes of 62 bits below it: about `bound` of so many rows, at any number of rows."""
    return (1 << 62) if rows <= bound else (bound << 62) // rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, label): about `bound` labelled rows outside the held-out fold, by a hash of doc_id.

    Rows with a null id or label are left out. All are taken where there are fewer than `bound`.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold != held))
    at = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 2)
    keep = rows.where(at < F.lit(sample_cut(rows.count(), bound))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return texts(docs).join(F.broadcast(keep), "doc_id")  # about `bound` rows of two numbers


def held_out(modulus: int, held: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held)
