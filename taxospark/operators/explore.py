"""Browsing: value pickers, key-set pages, coverage and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxospark.functions.codes import family
from taxospark.functions.text import normalized, trim
from taxospark.operators.store import Store
from taxospark.operators.taxonomy import is_small, with_title
from taxospark.schemas import MAX_PAGE, PICKER_VALUES


def values(courses: DataFrame, value: Column, search: str = "", limit: int = PICKER_VALUES) -> DataFrame:
    """(value, n): the most frequent non-blank values, trimmed, that contain the search text."""
    found = courses.select(trim(value).alias("value")).filter(F.col("value") != "")
    if search.strip():
        found = found.filter(F.contains(normalized(F.col("value")), F.lit(search.strip().lower())))
    return found.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def code_values(courses: DataFrame, results: DataFrame, taxonomy: DataFrame, model_id: int, level: int, search: str = "", limit: int = PICKER_VALUES) -> DataFrame:
    """(value, label, n): the most frequent codes of these records' results; labels are titles, of which level 4 has none."""
    codes = courses.select("content_hash").join(results.filter(F.col("model_id") == model_id).select("content_hash", F.col("classification").alias("value")), "content_hash")
    counted = codes.groupBy("value").agg(F.count("*").alias("n"))
    named = counted.withColumn("label", F.lit(None).cast("string")) if level == 4 else with_title(counted, taxonomy, "value", level, "label")
    if search.strip():
        text = F.lit(search.strip().lower())
        named = named.filter(F.contains(F.lower("value"), text) | F.coalesce(F.contains(F.lower("label"), text), F.lit(False)))
    return named.select("value", "label", "n").orderBy(F.desc("n"), "value").limit(limit)


def page(courses: DataFrame, cursor: int = 0, limit: int = MAX_PAGE) -> DataFrame:
    """Rows from a row_index on; the next page starts behind the last row's index."""
    return courses.filter(F.col("row_index") >= cursor).orderBy("row_index").limit(max(1, min(MAX_PAGE, limit)))


def between(courses: DataFrame, first: int, end: int) -> DataFrame:
    """Rows with a row_index from first to end - 1; both bounds reach the files' indexes."""
    return courses.filter((F.col("row_index") >= first) & (F.col("row_index") < end))


def known(results: DataFrame, model_id: int, hashes: Sequence[str]) -> DataFrame:
    """A model's results of some texts, from the buckets that have them."""
    return results.filter((F.col("model_id") == model_id) & F.col("content_hash").isin(list(hashes)))


def stored_page(store: Store, dataset_id: str, taxonomy: DataFrame, models: Mapping[int, int], cursor: int = 0, limit: int = MAX_PAGE, keep: Column | None = None) -> DataFrame:
    """A page of a stored dataset from a row_index on, of records for which `keep` holds, with their results as `attach` gives them.

    Records lie in order of row_index, so only a window behind the cursor is read. Where it has too few rows that are
    kept, it gets eight times as wide, until it has them or the records end. A page's rows come to the driver, MAX_PAGE at
    most, and their hashes reach the scan of the results.
    """
    limit, last = max(1, min(MAX_PAGE, limit)), store.last_row(dataset_id)
    rows, width = store.courses(dataset_id), 4 * limit
    if keep is not None:
        rows = rows.filter(keep)
    found: list = []
    while last is not None and cursor <= last and not found:
        part = between(rows, cursor, cursor + width).orderBy("row_index").limit(limit).collect()
        if len(part) == limit or cursor + width > last:
            found = part
            break
        width *= 8
    page_rows = rows.sparkSession.createDataFrame(found, rows.schema)
    hashes = sorted({r["content_hash"] for r in found})
    results = store.results()
    near = reduce(DataFrame.unionByName, (known(results, m, hashes) for m in dict.fromkeys(models.values())))
    return attach(page_rows, near, taxonomy, models)


def attach(rows: DataFrame, results: DataFrame, taxonomy: DataFrame, models: Mapping[int, int]) -> DataFrame:
    """A page's rows with the results of every level, one row for each record and level that has one.

    A page has MAX_PAGE rows at most, so it is broadcast to the results rather than the results sorted. title_level is
    the code's own level if its title is known, 2 if its parent's is, else null; descriptions go with own titles only.
    """
    small = F.broadcast if is_small(taxonomy) else lambda t: t
    of = {level: results.filter(F.col("model_id") == m) for level, m in models.items()}
    parents = small(taxonomy.filter("digit_level = 2").select(F.col("code").alias("_parent"), F.col("title").alias("_title"), F.col("title_short").alias("_short")))
    out = None
    for level, found in of.items():
        own = small(taxonomy.filter(F.col("digit_level") == level).select(F.col("code").alias("classification"), "title", "title_short", "description"))
        hits = found.select("content_hash", "classification", "probability").join(F.broadcast(rows), "content_hash").join(own, "classification", "left")
        hits = hits.withColumn("_parent", family(F.col("classification"))).join(parents, "_parent", "left")
        inherit = F.lit(level != 4)
        hits = hits.select(
            *rows.columns, F.lit(level).alias("level"), "classification", "probability",
            F.coalesce("title", F.when(inherit, F.col("_title"))).alias("title"),
            F.when(F.col("title").isNotNull(), F.col("title_short")).otherwise(F.when(inherit, F.col("_short"))).alias("title_short"),
            "description",
            F.when(F.col("title").isNotNull(), level).when(inherit & F.col("_title").isNotNull(), 2).alias("title_level"),
        )
        out = hits if out is None else out.unionByName(hits)
    return out


def coverage(courses: DataFrame, results: DataFrame, models: Mapping[int, int]) -> DataFrame:
    """(level, classified, total) for each level: rows, repeated ones too, that have a result of its active model."""
    spark = courses.sparkSession
    levels = F.broadcast(spark.createDataFrame(sorted((m, level) for level, m in models.items()), "model_id long, level int"))
    hits = courses.select("content_hash").join(results.select("model_id", "content_hash").join(levels, "model_id"), "content_hash")
    total = courses.agg(F.count("*").alias("total"))
    counted = hits.groupBy("level").agg(F.count("*").alias("classified"))
    return levels.join(counted, "level", "left").crossJoin(F.broadcast(total)).select("level", F.coalesce("classified", F.lit(0)).alias("classified"), "total").orderBy("level")


def percent(done: Column, total: Column) -> Column:
    """Null for none, 100 only when complete."""
    share = F.least(F.floor(done * 100 / F.when(total > 0, total)), F.lit(99))
    return F.when((done > 0) & (total > 0), F.when(done >= total, 100).otherwise(share)).cast("int")


def metrics(datasets: DataFrame, courses: DataFrame, results: DataFrame) -> DataFrame:
    """(datasets, courses, results): row counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(datasets, "datasets").crossJoin(one(courses, "courses")).crossJoin(one(results, "results"))


def match_counts(matched: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(dataset_id, position, n) of every source, zero where nothing matched."""
    listed = F.broadcast(matched.sparkSession.createDataFrame(list(enumerate(sources)), "position int, dataset_id string"))
    counted = matched.groupBy("dataset_id").agg(F.count("*").alias("n"))
    return listed.join(counted, "dataset_id", "left").select("dataset_id", "position", F.coalesce("n", F.lit(0)).alias("n")).orderBy("position")
