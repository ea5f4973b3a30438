"""A corpus pipeline of five stages; each works on all that the one before it kept.

All stages take documents with nulls in any column, empty and very long texts, equal and repeated rows,
and further columns of any name but those that the stages read (doc_id, text, source) or add; an
empty table gives an empty one. What each does with such rows stands with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, quality, simhash, substring_dedup
from tessera.llm._storage import removed, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go.

    A null, empty or wordless text fails; repeated rows share a verdict; rows without a doc_id are judged
    like others, but have no label to learn from; without labels only the base rules hold.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels).where("kept").select("row.*").select(*_order(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Groups are connected by texts whose sets of five-word shingles have a similarity of 0.8 or more; candidates
    come from SimHash fingerprints. Rows without a doc_id can't be told apart and stay, as do texts
    without a word; repeated rows of a kept document stay.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 that also stand elsewhere go; a document stays, with what is left of it.

    n_chars follows the text. A null text stays null, shorter ones stay whole; repeated rows are copies of each
    other and lose what they share, so their texts may become empty.
    """
    cleaned = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return cleaned.select(*_order(docs))


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    A null or short text overlaps with nothing; items of fewer than eight words match nothing; repeated rows share a
    verdict; an empty benchmark leaves all.
    """
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is drawn, with its copy, shard and position.

    A null source is a source of its own; texts without words weigh nothing; repeated rows and rows without a doc_id
    are drawn one by one. Input columns named copy, shard or position are replaced.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_overlaps),
    ("source_mixing", source_mix),
]

#: SQL can't tell the rows: the rules are learned, fingerprints and draws need 64-bit hashes.
ORACLE_SQL = None


def _order(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is a table in the shared folder, removed after its use.

    The last of these tables stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
