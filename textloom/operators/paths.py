"""Paths: discovery filters, member safety, claims on output names, archive budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.columns import output_path


@F.pandas_udf(T.StringType())
def portable_key(paths):
    return paths.map(rules.portable_key, na_action="ignore")


def discovered(path: Column, include_hidden: bool = False) -> Column:
    """The walk's own rule, for paths from elsewhere."""
    return F.pandas_udf(lambda paths: paths.map(lambda p: rules.discovered(p, include_hidden)), "boolean")(path)


def safe_member(name: Column) -> Column:
    """The plain form of an archive member's path, or null: the archive readers' own rule."""
    return F.pandas_udf(lambda names: names.map(rules.safe_member), "string")(name)


def claims(sources: DataFrame, key=portable_key) -> DataFrame:
    """source_path, output_path, clash: the first source, by column place, gets the plain name, others one with a marker.

    clash: the marked name is taken too, which is an error of that source.
    """
    rows = sources.select("source_path", "place", output_path("source_path").alias("plain"), output_path("source_path", True).alias("marked"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key(F.col("plain"))).orderBy("place", "source_path")))
    named = rows.select("source_path", "place", "rank", F.when(F.col("rank") == 1, F.col("plain")).otherwise(F.col("marked")).alias("output_path"))
    again = F.row_number().over(Window.partitionBy(key(F.col("output_path"))).orderBy(F.col("rank") > 1, "place", "source_path"))
    return named.select("source_path", "output_path", (again > 1).alias("clash"))


def over_budget(members: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """archive, over: whether an archive holds a member beyond the run's budget.

    Running totals need one order: only (archive, place, totals) rows meet in one task, and of those only as many as the budget
    allows files can be within it.
    """
    each = members.groupBy("archive", "place").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("archive", ((F.sum("files").over(w) > max_files) | (F.sum("bytes").over(w) > max_bytes)).alias("over"))
