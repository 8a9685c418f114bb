"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row for each text ever kept. A batch is reduced to
one row per digest before it is compared, then deduplicated by a sort-merge anti-join and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxospark.llm.common import attach, shared_path, with_row, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a batch for each bucket of a new index.
ROWS_A_BUCKET = 2_000_000


def text_digest(text: Column) -> Column:
    """SHA-256, in hex, of the text with A-Z lowered; a null text counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """A bucketed table of (digest binary, keep_id long) at a path; a later session opens it again by path and buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds those of batch(digest, keep_id, ...), which has each digest once, whose digest the index lacks; returns them."""
        fresh = batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # the fresh rows go to shared storage first, for a table can't be read and appended to in one job
        fresh = written(fresh, "digest-fresh")
        laid = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        laid.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        return fresh


def dedup(docs: DataFrame, index: DigestIndex | None = None, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; appends the new texts to the index.

    Texts are equal when identical after lowering A-Z; null counts as empty. Of equal texts in a batch one row stays, with
    the largest doc_id and, where that is repeated, the largest place; unless the index already has that text: then
    keep_id is the indexed document and none of the batch stays. group_size counts the rows of the batch. A null doc_id
    stays only where all equal texts have none. `row` names a column of longs, without nulls, that tells rows apart; it is
    returned too. Columns but these, doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    number = row or "row"
    own = docs.select(F.col("doc_id").cast("long"), F.unhex(text_digest(F.col("text"))).alias("digest"), *([row] if row else []))
    rows = written(own, "digests")
    if not row:
        rows = with_row(rows, number)
    total = rows.count()
    best = F.max(F.struct("doc_id", number))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = written(groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col(f"best.{number}").alias("keep_row"), "group_size"), "digest-groups")
    if index is None:
        index = DigestIndex(spark, shared_path(spark, "digest-index"), max(8, -(-total // ROWS_A_BUCKET)))
    fresh = index.append(groups).select("digest", "keep_row")
    known = groups.select("digest", "group_size").join(index.read().hint("merge"), "digest")
    kept = written(known.join(fresh.hint("merge"), "digest", "left"), "digest-kept")
    return attach(rows, kept, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.col(number).eqNullSafe(F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *([row] if row else [])
    )
