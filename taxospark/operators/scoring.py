"""Scoring distinct texts once: misses of the results cache, a pluggable batch model, native reduction, resumable runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxospark.functions.codes import canonical
from taxospark.functions.logits import reduced
from taxospark.functions.text import assembled
from taxospark.operators.shared import shared_path
from taxospark.operators.store import Store
from taxospark.schemas import FIELDS, RESULTS, SpecError

BATCH = 128
#: Distinct texts that are scored before their results are added, about; what a run that is lost has to do again.
BUCKET_TEXTS = 200_000


class Stopped(Exception):
    """Asks a run to end before its next bucket."""


class Scorer(Protocol):
    """A model: logits for a batch of texts, one list of floats a text."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def misses(courses: DataFrame, results: DataFrame, model_id: int) -> DataFrame:
    """(content_hash, input, first_row): the distinct texts that have no result of the model, as their first rows give them."""
    known = results.filter(F.col("model_id") == model_id).select("content_hash")
    new = courses.join(known, "content_hash", "left_anti")
    firsts = new.groupBy("content_hash").agg(*(F.min_by(f, "row_index").alias(f) for f in FIELDS), F.min("row_index").alias("first_row"))
    return firsts.select("content_hash", assembled(*(F.col(f) for f in FIELDS)).alias("input"), "first_row")


def miss_stats(courses: DataFrame, results: DataFrame, models: Mapping[int, int]) -> DataFrame:
    """(level, missing_rows, missing_unique) for each level's model."""
    out = None
    for level, model in sorted(models.items()):
        known = results.filter(F.col("model_id") == model).select("content_hash")
        per_hash = courses.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"))
        one = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing_rows"), F.count("*").alias("missing_unique")).select(F.lit(level).alias("level"), "missing_rows", "missing_unique")
        out = one if out is None else out.unionByName(one)
    return out


def progress(total: Column, missing_rows: Column, missing_unique: Column, done: Column) -> Column:
    """Rows covered so far, when `done` of the distinct misses are scored."""
    return (total - missing_rows + F.when(missing_unique > 0, F.floor(missing_rows * done / missing_unique)).otherwise(missing_rows)).cast("long")


def scored(inputs: DataFrame, make: Callable[[], Scorer], batch: int = BATCH) -> DataFrame:
    """(content_hash, logits) of inputs(content_hash, input). The model is made once a task; texts of like length share a batch, which keeps padding small."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "logits": [list(map(float, z)) for z in model(part["input"].tolist())]})

    laid = inputs.select("content_hash", "input").withColumn("_n", F.length("input")).sortWithinPartitions("_n").drop("_n")
    return laid.mapInPandas(run, "content_hash string, logits array<float>")


def as_results(logits: DataFrame, labels: Sequence[str], model_id: int, level: int) -> DataFrame:
    """Results rows of (content_hash, logits), codes in canonical form."""
    columns = reduced(F.col("logits"), labels)
    columns = {n: canonical(c, level) if n == "classification" or n.endswith("_code") else c for n, c in columns.items()}
    rows = logits.select("content_hash", *(c.alias(n) for n, c in columns.items()))
    return rows.withColumn("model_id", F.lit(model_id).cast("long")).withColumn("computed_at", F.current_timestamp()).select(*RESULTS.names)


def classify(store: Store, dataset_id: str, models: Sequence[tuple[int, int, Sequence[str], Callable[[], Scorer]]], buckets: int | None = None, before_bucket: Callable[[int, int], None] | None = None) -> int:
    """Scores what a dataset lacks for each (level, model_id, labels, scorer), bucket by bucket of the hash; returns the number of new results.

    A bucket's append is the unit of durability: a failed run leaves whole buckets only, and the next run's anti-join
    starts behind them. There are as many as make BUCKET_TEXTS texts a bucket, unless their number is given.
    before_bucket(level, bucket) may raise Stopped to stop a run. The dataset's classify_state is running meanwhile, then
    idle, stopped or failed. What each level lacks, and what is done after each bucket, goes to the store's run log.
    """
    state = store.datasets().filter(F.col("id") == dataset_id).select(F.coalesce("import_state", F.lit("ready"))).first()
    if state is None or state[0] != "ready":
        raise SpecError(f"dataset {dataset_id} isn't ready")
    mine = store.courses(dataset_id)
    if mine.isEmpty():
        raise SpecError(f"dataset {dataset_id} has no rows")
    store.update_dataset(dataset_id, classify_state="running")
    end, new, run = "failed", 0, uuid.uuid4().hex
    try:
        total = mine.count()
        for level, model_id, labels, make in sorted(models, key=lambda m: m[0]):
            # the level's misses are found once, and laid out so that a bucket is a folder
            lacking = misses(mine, store.results(), model_id)
            lacks = miss_stats(mine, store.results(), {level: model_id}).first()
            many = buckets or max(1, -(-lacks["missing_unique"] // BUCKET_TEXTS))
            bucket = F.pmod(F.xxhash64("content_hash"), F.lit(many))
            path = shared_path(store.spark, "misses")
            lacking.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
            todo = store.spark.read.schema("content_hash string, input string, first_row long, bucket long").parquet(path)
            sizes = {r["bucket"]: r["count"] for r in todo.groupBy("bucket").count().collect()}
            entry = {"run": run, "dataset_id": dataset_id, "level": level, "total": total, "missing_rows": lacks["missing_rows"], "missing_unique": lacks["missing_unique"]}
            done = 0
            store.log(**entry, done=done)
            for k in range(many):
                if before_bucket:
                    before_bucket(level, k)
                if k in sizes:
                    store.append_results(as_results(scored(todo.filter(F.col("bucket") == k), make), labels, model_id, level), model_id)
                    done, new = done + sizes[k], new + sizes[k]
                    store.log(**entry, done=done)
        end = "idle"
    except Stopped:
        end = "stopped"
    finally:
        store.update_dataset(dataset_id, classify_state=end)
    return new


def run_progress(store: Store, dataset_id: str, last: int = 8) -> DataFrame:
    """(level, total, covered, done, rows_per_second) of each level of a dataset's last run, from the log that it writes; any session may ask while it runs."""
    log = store.run_log().filter(F.col("dataset_id") == dataset_id)
    run = log.orderBy(F.desc("at")).select("run").first()
    log = log.filter(F.col("run") == (run[0] if run else ""))
    recent = Window.partitionBy("level").orderBy(F.desc("at"))
    near = log.withColumn("place", F.row_number().over(recent)).filter(F.col("place") <= last)
    seconds = F.max("at").cast("double") - F.min("at").cast("double")
    rate = F.when(seconds > 0, (F.max("done") - F.min("done")) / seconds).alias("rows_per_second")
    newest = [F.max_by(c, "at").alias(c) for c in ("total", "missing_rows", "missing_unique", "done")]
    told = near.groupBy("level").agg(*newest, rate)
    return told.select("level", "total", progress(*(F.col(c) for c in ("total", "missing_rows", "missing_unique", "done"))).alias("covered"), "done", "rows_per_second").orderBy("level")


def swept(datasets: DataFrame) -> DataFrame:
    """The datasets after a crash: what was running is stopped, what was importing has failed."""
    lost = F.col("import_state") == "importing"
    return datasets.withColumns(
        {
            "classify_state": F.when(F.col("classify_state") == "running", "stopped").otherwise(F.col("classify_state")),
            "import_error": F.when(lost, "the import was interrupted").otherwise(F.col("import_error")),
            "import_state": F.when(lost, "failed").otherwise(F.col("import_state")),
        }
    )


def sweep(store: Store) -> None:
    """Writes back what datasets are after a crash, and removes what lost writers left. Only for when nothing writes to the store."""
    store.sweep()
    store.edit("datasets", swept)


def active_models(models: DataFrame) -> dict[int, int]:
    """Level to active model id, from models(id, model_type, active); model_type is the level as text."""
    return {int(r["model_type"]): r["id"] for r in models.filter("active").select("id", "model_type").collect()}


def throughput(log: DataFrame, last: int = 8) -> DataFrame:
    """(rows_per_second) over the last samples of log(at timestamp, done)."""
    recent = log.orderBy(F.desc("at")).limit(last)
    seconds = F.max("at").cast("double") - F.min("at").cast("double")
    return recent.agg(F.when(seconds > 0, (F.max("done") - F.min("done")) / seconds).alias("rows_per_second"))
