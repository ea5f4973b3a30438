"""Summaries of files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import prefix
from tessera.operators.small import small


def file_summary(files: DataFrame) -> DataFrame:
    """One row: files, total_kb (rounded to 2)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(T.rounded(F.sum("size_kb"), 2), F.lit(0.0)).alias("total_kb"))


def files_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif("extension", F.lit("")), F.lit("unknown")).alias("extension")).agg(F.count("*").alias("files"))


def paths_by_language(files: DataFrame, path: str = "path") -> DataFrame:
    """(language, n, place, path): the paths of each language in order, from place 1 on, and how many it has."""
    own = files.select(P.language(path).alias("language"), F.col(path).alias("path"))
    counts = own.groupBy("language").agg(F.count("*").alias("n"))
    return prefix.running(own, ["language"], ["path"], place="place").join(small(counts), "language").select("language", "n", "place", "path")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))


def counts_by(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(column).agg(F.count("*").alias("n"))


def path_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """(depth, prefix, name, is_file): every folder and file once."""
    return files.select(F.explode(P.prefixes(path)).alias("p")).select("p.*").distinct()


def icons(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(path, P.icon(path).alias("icon"))


def filter_options(chunks: DataFrame, column: str, everything: str) -> DataFrame:
    """(position, option): the label for no filter, then the distinct non-empty values."""
    values = chunks.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("option")).distinct()
    head = chunks.sparkSession.createDataFrame([(0, everything)], "position int, option string")
    return head.unionByName(values.select(F.lit(1).alias("position"), "option")).orderBy("position", "option")
