"""Continuous import: a folder of files into a dataset, each micro-batch scored against the results cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxospark.operators.importing import imported
from taxospark.operators.scoring import Scorer, as_results, misses, scored
from taxospark.operators.store import Store
from taxospark.schemas import Layout
from taxospark.sources.delimited import courses


def records(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """A stream of the folder's records. A record's number is unique and grows with its batch, but isn't its place in a file."""
    schema = ", ".join(f"_c{i} string" for i in range(len(layout.headers)))
    return spark.readStream.schema(schema).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def import_stream(spark: SparkSession, store: Store, path: str, layout: Layout, dataset_id: str, checkpoint: str, model: tuple[int, int, Sequence[str], Callable[[], Scorer]] | None = None) -> StreamingQuery:
    """Imports new files as they come, and scores texts that the cache lacks; both are safe to repeat.

    A batch's records go to a partition of its own, dataset_id-<batch>, which a repeated batch overwrites; the anti-join
    against the cache makes scoring a repeated batch a no-op. model: (level, model_id, labels, scorer).
    """

    def run(batch: DataFrame, number: int) -> None:
        filled = batch.select(*(F.coalesce(c, F.lit("")).alias(c) for c in batch.columns)).withColumn("row_index", F.lit(number * (1 << 40)) + F.monotonically_increasing_id())
        rows = imported(courses(filled, layout), f"{dataset_id}-{number}").persist()
        store.write_courses(rows)
        if model:
            level, model_id, labels, make = model
            store.append_results(as_results(scored(misses(rows, store.results(), model_id), make), labels, model_id, level), model_id)
        rows.unpersist()

    return records(spark, path, layout).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
