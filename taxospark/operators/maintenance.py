"""Upkeep of results and datasets: usage, pruning, deletion, comparison, latest states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxospark.operators.shared import free_name, quoted
from taxospark.operators.store import Store
from taxospark.schemas import SpecError

BUSY_IMPORT, BUSY_CLASSIFY, DELETING = "importing", "running", "deleting"


def cache_usage(results: DataFrame, courses: DataFrame, active: Sequence[int]) -> DataFrame:
    """(total, superseded, unreferenced): rows, rows of models no longer active (none if no model is), and rows whose text no record has."""
    old = ~F.col("model_id").isin(list(active)) if active else F.lit(False)
    counts = results.agg(F.count("*").alias("total"), F.count_if(old).alias("superseded"))
    return counts.crossJoin(unreferenced(results, courses).agg(F.count("*").alias("unreferenced")))


def unreferenced(results: DataFrame, courses: DataFrame) -> DataFrame:
    return results.join(courses.select("content_hash"), "content_hash", "left_anti").select(*results.columns)


def without_superseded(results: DataFrame, active: Sequence[int]) -> DataFrame:
    return results.filter(F.col("model_id").isin(list(active))) if active else results


def without_unreferenced(results: DataFrame, courses: DataFrame) -> DataFrame:
    return results.join(courses.select("content_hash"), "content_hash", "left_semi").select(*results.columns)


def exclusive(store: Store):
    """Holds the lock that lets one upkeep operation run at a time; another one is refused at once."""
    return store.locked("maintenance", wait=0)


def prune_superseded(store: Store, active: Sequence[int]) -> int:
    """Drops the results of models no longer active; returns the rows dropped. Refused beside any other upkeep, import or scoring."""
    if not active:
        return 0
    with exclusive(store):
        check_idle(store.datasets())
        counts = store.results().groupBy("model_id").agg(F.count("*").alias("n")).filter(~F.col("model_id").isin(list(active))).collect()
        for r in counts:
            store.drop_results(r["model_id"])
    return sum(r["n"] for r in counts)


def prune_unreferenced(store: Store) -> int:
    """Rewrites the results of models that have some whose text no record has, without those; returns the rows dropped. Refused like the above."""
    with exclusive(store):
        check_idle(store.datasets())
        counts = unreferenced(store.results(), store.courses()).groupBy("model_id").agg(F.count("*").alias("n")).collect()
        for r in counts:
            mine = store.results().filter(F.col("model_id") == r["model_id"])
            store.rewrite_results(r["model_id"], without_unreferenced(mine, store.courses()))
    return sum(r["n"] for r in counts)


def check_idle(datasets: DataFrame) -> None:
    """Refuses an operation while anything is being imported or scored."""
    busy = datasets.filter((F.col("import_state") == BUSY_IMPORT) | (F.col("classify_state") == BUSY_CLASSIFY)).select("id").first()
    if busy:
        raise SpecError(f"dataset {busy[0]} is busy")


def delete_dataset(store: Store, dataset_id: str) -> bool:
    """Removes a dataset's records, then its entry; results are kept, and deleting again does nothing.

    Refused while it is busy, while a dataset that is derived from it is being made, and beside other upkeep. The entry's
    state is deleting meanwhile, so that a deletion that is cut off shows; deleting again, or `finish_deletions`, ends it.
    The entry of its source file goes with the last dataset that was imported from it. Datasets derived from it keep its
    title.
    """
    mine = store.datasets().filter(F.col("id") == dataset_id)
    check_idle(mine)
    if mine.isEmpty():
        return False
    derived = store.dataset_sources().filter(F.col("source_dataset_id") == dataset_id).select(F.col("dataset_id").alias("id"))
    check_idle(store.datasets().join(derived, "id", "left_semi"))
    with exclusive(store):
        store.update_dataset(dataset_id, import_state=DELETING, import_error=None)
        _delete(store, dataset_id)
    return True


def _delete(store: Store, dataset_id: str) -> None:
    entry = store.datasets().filter(F.col("id") == dataset_id).select("source_file_id").first()
    store.name_courses(dataset_id, None)
    store.edit("dataset_sources", lambda t: t.filter(F.col("dataset_id") != dataset_id))
    store.edit("datasets", lambda t: t.filter(F.col("id") != dataset_id))
    if entry and entry[0] and store.datasets().filter(F.col("source_file_id") == entry[0]).isEmpty():
        store.edit("source_files", lambda t: t.filter(F.col("id") != entry[0]))


def incomplete(store: Store) -> list[str]:
    """Ids of datasets whose deletion was cut off: marked so while no upkeep runs."""
    if store.is_locked("maintenance"):
        return []
    return [r[0] for r in store.datasets().filter(F.col("import_state") == DELETING).select("id").orderBy("id").collect()]


def finish_deletions(store: Store) -> list[str]:
    """Ends the deletions that were cut off; returns their ids."""
    left = incomplete(store)
    with exclusive(store):
        for dataset_id in left:
            _delete(store, dataset_id)
    return left


#: Groups of rows whose digests are compared before any rows are.
DIGEST_BUCKETS = 4096


def hashable(df: DataFrame) -> DataFrame:
    """df with maps as their sorted entries, by which rows can be hashed and grouped."""
    return df.select(*(F.array_sort(F.map_entries(quoted(f.name))).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(quoted(f.name)) for f in df.schema))


def multiset_digests(df: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(bucket, n, first, second): rows by a hash of all columns, and sums of two hashes of them, which don't depend on their order.

    Each task sums its own rows, so that a row a bucket and task is shuffled.
    """
    columns = [quoted(c) for c in df.columns]
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    hashed = df.select(F.pmod(first, F.lit(buckets)).cast("int").alias("bucket"), first.cast("decimal(20,0)").alias("x"), second.cast("decimal(20,0)").alias("y"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("x").alias("first"), F.sum("y").alias("second"))


def tables_equal(a: DataFrame, b: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(rows_a, rows_b, only_a, only_b, equal): as multisets of rows.

    Digests of buckets of rows are compared first; only rows of buckets that differ are compared themselves. The number
    of buckets is fixed, so what comes to the driver is bounded. Two different buckets pass as equal with a chance of
    about 2 ** -128.
    """
    a, b = hashable(a), hashable(b.select(*(quoted(c) for c in a.columns)))
    x, y = (multiset_digests(df, buckets).alias(name) for df, name in ((a, "x"), (b, "y")))
    both = x.join(y, F.col("x.bucket") == F.col("y.bucket"), "full").select(
        F.coalesce("x.bucket", "y.bucket").alias("bucket"), *(F.coalesce(F.col(f"{t}.n"), F.lit(0)).alias(f"n_{t}") for t in "xy"),
        (F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.first").eqNullSafe(F.col("y.first")) & F.col("x.second").eqNullSafe(F.col("y.second"))).alias("same"),
    )
    told = both.collect()
    rows_a, rows_b = (sum(r[f"n_{t}"] for r in told) for t in "xy")
    other = [r["bucket"] for r in told if not r["same"]]
    sizes = [F.lit(n).cast("long").alias(name) for n, name in ((rows_a, "rows_a"), (rows_b, "rows_b"))]
    zero = F.lit(0).cast("long")
    if not other:
        return a.sparkSession.range(1).select(*sizes, zero.alias("only_a"), zero.alias("only_b"), F.lit(True).alias("equal"))
    in_a, in_b = free_name(a, "_a"), free_name(a, "_b")
    columns = [quoted(c) for c in a.columns]
    mine = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").isin(other) if len(other) < buckets else F.lit(True)
    tagged = a.filter(mine).select(*columns, F.lit(1).alias(in_a), F.lit(0).alias(in_b)).unionByName(b.filter(mine).select(*columns, F.lit(0).alias(in_a), F.lit(1).alias(in_b)))
    per_row = tagged.groupBy(*columns).agg((F.sum(in_a) - F.sum(in_b)).alias("_more"))
    only = lambda c: F.coalesce(F.sum(F.greatest(c, zero)), zero)
    out = per_row.agg(only(F.col("_more")).alias("only_a"), only(-F.col("_more")).alias("only_b"))
    return out.select(*sizes, "only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))


def latest_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each key's last row by the order."""
    rank = free_name(df, "_rank")
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn(rank, last).filter(F.col(rank) == 1).drop(rank)
