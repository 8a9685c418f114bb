"""Corpus curation in five stages, from raw documents to packed training sequences.

Each stage reads all that its predecessor kept, as Parquet, and its decisions take effect. All but the last return the
columns of documents; n_chars follows the text that is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxospark.llm import exact_dedup, packing, quality, simhash, substring_dedup
from taxospark.llm.common import free_name, quoted, table, with_row, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def judged(docs: DataFrame, verdict: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs that verdict, called with rows and the name of the column that tells them apart, says are kept.

    So rows without an id and rows that repeat one are judged singly.
    """
    row = free_name(docs, "_row")
    rows = with_row(docs, row)
    kept = verdict(rows, row).filter("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*quoted(docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; rows that repeat a doc_id or have none are judged by their texts alike."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest doc_id; a null one stays only where all have none."""
    return judged(docs, lambda rows, row: exact_dedup.dedup(rows, row=row))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints one row, that with the smallest doc_id; a null one stays only where all have none."""
    return judged(docs, lambda rows, row: simhash.near_duplicates(rows, row=row))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentence spans that an earlier one has; those that had a text and lose all of it but white space go."""
    row, removed = free_name(docs, "_row"), free_name(docs, "_removed")
    changed = substring_dedup.dedup(with_row(docs, row), row=row, removed=removed)
    left = changed.filter((F.col(removed) == 0) | F.col("text").rlike(r"(?U)\S"))
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*quoted(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, of every row."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: None: classifier, fingerprints, sentence spans and tokenizer aren't for SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
