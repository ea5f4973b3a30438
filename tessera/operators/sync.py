"""Incremental sync of a chunk table with the files it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """(path, stored): the first non-empty content hash of each source, by chunk index."""
    return chunks.where("content_hash <> ''").groupBy(F.col("source").alias("path")).agg(F.min_by("content_hash", "chunk_index").alias("stored"))


def diff(files: DataFrame, stored: DataFrame, full_sync: bool = False) -> DataFrame:
    """(path, status) from files (path, hash) and stored (path, stored): new, updated, unchanged; with ``full_sync`` also deleted.

    Of a path that comes twice the smallest hash counts.
    """
    own = files.groupBy("path").agg(F.min("hash").alias("hash"))
    both = own.join(stored, "path", "full_outer" if full_sync else "left")
    status = F.when(F.col("hash").isNull(), "deleted").when(F.col("stored").isNull(), "new").when(F.col("hash") != F.col("stored"), "updated").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def stats(found: DataFrame) -> DataFrame:
    """One row: files_new, files_updated, files_unchanged, files_deleted."""
    return found.agg(*(F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("new", "updated", "unchanged", "deleted")))


def replace(chunks: DataFrame, found: DataFrame, added: DataFrame) -> DataFrame:
    """``chunks`` without those of updated and deleted files, and with ``added``; one table to be swapped in."""
    gone = found.where(F.col("status").isin("updated", "deleted")).select(F.col("path").alias("source"))
    return chunks.join(gone, "source", "left_anti").unionByName(added, allowMissingColumns=True)


def delete_sources(chunks: DataFrame, sources: list[str]) -> DataFrame:
    """``chunks`` of all other sources; those without a source stay."""
    return chunks.where(~F.coalesce(F.col("source").isin(*sources), F.lit(False))) if sources else chunks
