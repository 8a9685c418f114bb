"""Profiles of the three fields: tallies, lengths, shapes, checks, findings, examples and samples.

Each report is one aggregate over the records in long form, (field, value) for the three fields, or over one row of
counters. Nothing is capped while it is counted; reported caps are applied to exact figures.

A whole profile is made from a `State`, which has all that a profile takes from records. States of several datasets
merge into that of their records one after another, so a merge's profile needs no scan of its sources.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxospark.functions.checks import CARDINALITY_ROWS, CHECKS, HIGH_CARDINALITY, LOW_CARDINALITY, ROW_CHECKS, row_checks
from taxospark.functions.text import assembled, content_hash, display, shape, trim, truncated
from taxospark.operators.filters import importable
from taxospark.operators.shared import shared_path, written
from taxospark.schemas import FIELDS

SHORT = {"subject": "subject_code", "catalog": "catalog_number", "title": "course_title"}
# Bounds of what a report shows.
TOP_VALUES, TOP_SHAPES, EXAMPLES, SAMPLES = 10, 8, 10, 8
LENGTHS, DISTINCT_CAP, KEY_BYTES = 256, 100_000, 256


def prepared(records: DataFrame) -> DataFrame:
    """Records with trimmed fields (null as empty) and `importable`."""
    clean = records.withColumns({f: F.coalesce(trim(F.col(f)), F.lit("")) for f in FIELDS})
    return clean.withColumn("importable", importable(*(F.col(f) for f in FIELDS)))


def long_form(records: DataFrame) -> DataFrame:
    """(field, value), three rows a record."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in SHORT.items()))
    return records.select(F.inline(pairs))


def _keyed(rows: DataFrame, n: Column) -> DataFrame:
    """(field, value, n): values as they are tallied, cut to KEY_BYTES."""
    return rows.groupBy("field", truncated(F.col("value"), KEY_BYTES).alias("value")).agg(n.alias("n"))


def _top(counted: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), key))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def _tallied(keyed: DataFrame) -> DataFrame:
    distinct = F.count_if(F.col("value") != "")
    empty = F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0))
    return keyed.groupBy("field").agg(empty.alias("empty"), F.least(distinct, F.lit(DISTINCT_CAP)).alias("distinct"), (distinct > DISTINCT_CAP).alias("distinct_capped"))


def tallies(records: DataFrame) -> DataFrame:
    """(field, empty, distinct, distinct_capped) over all records."""
    return _tallied(_keyed(long_form(records), F.count("*")))


def top_values(records: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(field, rank, value, n): the most frequent non-empty values of each field over all records."""
    return _top(_keyed(long_form(records).filter("value != ''"), F.count("*")), "value", k).select("field", "rank", "value", "n")


def _sized(rows: DataFrame, n: Column) -> DataFrame:
    return rows.groupBy("field", F.least(F.length("value"), F.lit(LENGTHS - 1)).alias("size")).agg(n.alias("n"))


def _spread(sized: DataFrame) -> DataFrame:
    # at most LENGTHS rows a field
    before = F.sum("n").over(Window.partitionBy("field").orderBy("size"))
    total = F.sum("n").over(Window.partitionBy("field"))
    ranked = sized.select("field", "size", before.alias("upto"), total.alias("total"))
    middle = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("size")))
    return ranked.groupBy("field").agg(F.min("size").alias("len_min"), middle.alias("len_median"), F.max("size").alias("len_max"))


def lengths(records: DataFrame) -> DataFrame:
    """(field, len_min, len_median, len_max) over importable records; lengths from LENGTHS - 1 on count as that, and the median is the lower one."""
    return _spread(_sized(long_form(records.filter("importable")), F.count("*")))


def _top_shapes(values: DataFrame, k: int) -> DataFrame:
    return _top(values.groupBy("field", shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n")), "shape", k).select("field", "rank", "shape", "n")


def top_shapes(records: DataFrame, k: int = TOP_SHAPES) -> DataFrame:
    """(field, rank, shape, n) over importable records. Values are counted before they are turned into shapes."""
    return _top_shapes(long_form(records.filter("importable")).groupBy("field", "value").agg(F.count("*").alias("n")), k)


def skips(records: DataFrame) -> DataFrame:
    """(rows, importable, skipped, skipped_subject, skipped_catalog, skipped_title)."""
    return records.agg(
        F.count("*").alias("rows"), F.count_if("importable").alias("importable"), F.count_if(~F.col("importable")).alias("skipped"),
        *(F.count_if(F.col(c) == "").alias(f"skipped_{k}") for k, c in SHORT.items()),
    )


def _hits() -> dict[str, Column]:
    return row_checks(*(F.col(f) for f in FIELDS))


def _hit_counts(records: DataFrame) -> DataFrame:
    """One row: how many importable records each row check met, and `importable`."""
    found = _hits()
    return records.filter("importable").agg(*(F.count_if(found[c]).alias(c) for c in ROW_CHECKS), F.count("*").alias("importable"))


def check_counts(records: DataFrame) -> DataFrame:
    """(position, code, field, severity, threshold, count, rate, fired) of all checks, in report order."""
    return _judged(_hit_counts(records), tallies(records))


def _judged(counts: DataFrame, tallied: DataFrame) -> DataFrame:
    distinct = tallied.groupBy().agg(*(F.max(F.when(F.col("field") == k, F.col("distinct"))).alias(f"distinct_{k}") for k in SHORT))
    one = counts.crossJoin(distinct)  # a row each
    whole = F.col("importable")
    big = whole >= CARDINALITY_ROWS
    entries = []
    for i, c in enumerate(CHECKS):
        if c.threshold is not None:
            count = F.col(c.code)
            rate = F.when(whole > 0, count / whole).otherwise(F.lit(0.0))
            fired = (count > 0) & (rate >= c.threshold)
        else:
            n = F.coalesce(F.col(f"distinct_{c.field}"), F.lit(0))
            fired = big & ((n <= LOW_CARDINALITY) if c.field == "catalog" else (n / whole > HIGH_CARDINALITY))
            fired = F.coalesce(fired, F.lit(False))
            count, rate = F.when(fired, n).otherwise(F.lit(0)), F.lit(0.0)
        entries.append(F.struct(
            F.lit(i).alias("position"), F.lit(c.code).alias("code"), F.lit(c.field).alias("field"), F.lit(c.severity).alias("severity"),
            F.lit(c.threshold).cast("double").alias("threshold"), count.cast("long").alias("count"), rate.cast("double").alias("rate"), fired.alias("fired"),
        ))
    return one.select(F.inline(F.array(*entries)))


def findings(records: DataFrame) -> DataFrame:
    """The checks that fired, warnings first, else in report order."""
    fired = check_counts(records).filter("fired")
    return fired.orderBy(F.col("severity") == "info", "position").select("code", "field", "severity", "count", "rate")


def _firsts(records: DataFrame, k: int) -> DataFrame:
    """(code, rank, row_index) of the first k records that each row check, or skipping, met. A task holds k numbers a code, whatever it reads."""
    codes, found = (*ROW_CHECKS, "skipped"), _hits()
    tests = [*(F.col("importable") & found[c] for c in ROW_CHECKS), ~F.col("importable")]
    bits = (F.when(test, F.lit(1 << i)).otherwise(0) for i, test in enumerate(tests))
    mask = reduce(lambda x, y: x.bitwiseOR(y), bits).cast("long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in codes]
        for b in batches:
            rows, met = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(len(codes)):
                more = rows[(met >> i) & 1 == 1]
                if len(more):
                    held[i] = np.sort(np.concatenate([held[i], np.partition(more, k - 1)[:k] if len(more) > k else more]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, h in zip(codes, held) for _ in h], pa.string()), pa.array(np.concatenate(held))], ["code", "row_index"])

    first = records.select("row_index", mask.alias("met")).mapInArrow(run, "code string, row_index long")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("row_index"))).filter(F.col("rank") <= k)


def examples(records: DataFrame, k: int = EXAMPLES, first_row: int = 2) -> DataFrame:
    """(code, rank, row, input): the first records that each row check, or skipping, met."""
    # k rows a code at most
    shown = records.select("row_index", *FIELDS).join(F.broadcast(_firsts(records, k)), "row_index")
    return shown.select("code", "rank", (F.col("row_index") + first_row).alias("row"), display(assembled(*(F.col(f) for f in FIELDS))).alias("input"))


def _chosen(records: DataFrame, k: int, seed: int) -> DataFrame:
    """(key, row_index, input): of the distinct inputs those k with the smallest hashes, each at its first record."""
    fields = [F.col(f) for f in FIELDS]
    distinct = records.filter("importable").groupBy(content_hash(*fields).alias("h")).agg(F.min_by(assembled(*fields), "row_index").alias("input"), F.min("row_index").alias("row_index"))
    return distinct.select(F.xxhash64("h", F.lit(seed)).alias("key"), "row_index", display(F.col("input")).alias("input")).orderBy("key", "row_index").limit(k)


def samples(records: DataFrame, k: int = SAMPLES, seed: int = 42, first_row: int = 2) -> DataFrame:
    """(row, input): some distinct inputs, the same ones each time, spread over the dataset by a hash of the input."""
    return _chosen(records, k, seed).select((F.col("row_index") + first_row).alias("row"), "input").orderBy("row")


@dataclass(frozen=True)
class State:
    """What a profile takes from records.

    values is (field, value, n, importable): how many records have a value, and how many of those are importable. marks
    is bounded: {"skips": counters, "checks": counters, "examples": {code: [[row_index, place, input]]}, "samples": [[key,
    row_index, place, input]]}, where a place is the number of importable records before, and null for skipped ones.
    """

    values: DataFrame
    marks: dict


def _places(base: DataFrame, rows: Sequence[int]) -> dict[int, int]:
    """For each of a few row_index the number of importable records before it, by one aggregate."""
    if not rows:
        return {}
    cuts = sorted(set(rows))
    stretch = F.size(F.filter(F.array(*(F.lit(r).cast("long") for r in cuts)), lambda r: r <= F.col("row_index")))
    told = {r["stretch"]: r["n"] for r in base.filter("importable").groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n")).collect()}
    upto = list(accumulate(told.get(i, 0) for i in range(len(cuts))))
    return {r: upto[bisect_right(cuts, r) - 1] for r in cuts}


def state(records: DataFrame, folder: str | None = None) -> State:
    """The state of records(row_index and the three fields), written to the folder, or to the shared one if none is given.

    Records are written and their values counted once; the jobs on them run side by side.
    """
    base = written(prepared(records.select("row_index", *FIELDS)), "profile")
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in SHORT.items()))
    values = base.select(F.col("importable").alias("whole"), F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("whole").alias("importable"))
    parts = {
        "skips": skips(base), "checks": _hit_counts(base), "samples": _chosen(base, SAMPLES, 42),
        "examples": examples(base, first_row=0).orderBy("code", "rank"), "last": base.agg(F.max("row_index").alias("last")),
    }
    folder = folder or shared_path(base.sparkSession, "profile-state")
    with ThreadPoolExecutor(len(parts) + 1) as pool:
        writing = pool.submit(lambda: values.write.parquet(f"{folder}/values"))
        found = dict(zip(parts, pool.map(lambda df: [r.asDict() for r in df.collect()], parts.values())))
        writing.result()
    told, checks = found["skips"][0], found["checks"][0]
    shown = [r["row"] for r in found["examples"] if r["code"] != "skipped"] + [r["row_index"] for r in found["samples"]]
    dense = told["skipped"] == 0 and found["last"][0]["last"] == told["rows"] - 1
    place = {r: r for r in shown} if dense else _places(base, shown)
    marks: dict = {"skips": told, "checks": {c: checks[c] for c in ROW_CHECKS}, "examples": {}}
    for r in found["examples"]:
        marks["examples"].setdefault(r["code"], []).append([r["row"], None if r["code"] == "skipped" else place[r["row"]], r["input"]])
    marks["samples"] = [[r["key"], r["row_index"], place[r["row_index"]], r["input"]] for r in found["samples"]]
    return _kept(values, marks, folder)


def _kept(values: DataFrame, marks: dict, folder: str) -> State:
    """The state whose values were written to a folder; its marks are written there last, so that a state with marks is whole."""
    spark = values.sparkSession
    spark.createDataFrame([(json.dumps(marks),)], "marks string").coalesce(1).write.parquet(f"{folder}/marks")
    return State(spark.read.schema(values.schema).parquet(f"{folder}/values"), marks)


def stored_state(spark: SparkSession, folder: str) -> State:
    """A state as it was written to a folder."""
    told = spark.read.schema("marks string").parquet(f"{folder}/marks").first()
    return State(spark.read.schema("field string, value string, n long, importable long").parquet(f"{folder}/values"), json.loads(told[0]))


def merged(states: Sequence[State], folder: str | None = None) -> State:
    """The state of the importable records of several datasets one after another, numbered from 0, from their states alone."""
    whole = reduce(DataFrame.unionByName, (s.values for s in states)).filter("importable > 0")
    n = F.sum("importable")
    values = whole.groupBy("field", "value").agg(n.alias("n"), n.alias("importable"))
    folder = folder or shared_path(values.sparkSession, "profile-state")
    values.write.parquet(f"{folder}/values")
    sizes = [s.marks["skips"]["importable"] for s in states]
    total = sum(sizes)
    out: dict = {"skips": {"rows": total, "importable": total, "skipped": 0} | {f"skipped_{k}": 0 for k in SHORT}}
    out["checks"] = {c: sum(s.marks["checks"][c] for s in states) for c in ROW_CHECKS}
    out["examples"], first = {}, {}
    for s, before in zip(states, accumulate([0, *sizes])):
        for code in ROW_CHECKS:
            for _, place, text in s.marks["examples"].get(code, []):
                out["examples"].setdefault(code, []).append([before + place, before + place, text])
        for key, _, place, text in s.marks["samples"]:
            first.setdefault(key, [key, before + place, before + place, text])
    out["examples"] = {code: rows[:EXAMPLES] for code, rows in sorted(out["examples"].items())}
    out["samples"] = [first[key] for key in sorted(first)[:SAMPLES]]
    return _kept(values, out, folder)


def report(made: State, first_row: int = 2) -> dict:
    """A profile as a dict; every part of it is bounded."""
    values, marks = made.values, made.marks
    spark = values.sparkSession
    keyed = _keyed(values, F.sum("n"))
    tallied = _tallied(keyed)
    whole = values.filter("importable > 0").select("field", "value", F.col("importable").alias("n"))
    counts = spark.createDataFrame([tuple(marks["checks"][c] for c in ROW_CHECKS) + (marks["skips"]["importable"],)], ", ".join(f"{c} long" for c in (*ROW_CHECKS, "importable")))
    parts = {
        "tallies": tallied, "lengths": _spread(_sized(whole, F.sum("n"))), "checks": _judged(counts, tallied).orderBy("position"),
        "columns": _top(keyed.filter("value != ''"), "value", TOP_VALUES).select("field", "rank", "value", "n").orderBy("field", "rank"),
        "fields": _top_shapes(whole, TOP_SHAPES).orderBy("field", "rank"),
    }
    with ThreadPoolExecutor(len(parts)) as pool:
        found = dict(zip(parts, pool.map(lambda df: [r.asDict() for r in df.collect()], parts.values())))
    out = dict(marks["skips"])
    out["columns"] = {r.pop("field"): r for r in found["tallies"]}
    out["fields"] = {r.pop("field"): r for r in found["lengths"]}
    for key in ("columns", "fields"):
        for r in found[key]:
            out[key].setdefault(r.pop("field"), {}).setdefault("top", []).append(r)
    out["checks"] = [{"code": r["code"], "count": r["count"]} for r in found["checks"]]
    shown = {code: [{"row": row + first_row, "input": text} for row, _, text in rows] for code, rows in marks["examples"].items()}
    fired = sorted((r for r in found["checks"] if r["fired"]), key=lambda r: (r["severity"] == "info", r["position"]))
    out["findings"] = [{k: r[k] for k in ("code", "field", "severity", "count", "rate")} | {"examples": shown.get(r["code"], [])} for r in fired]
    out["skipped_examples"] = shown.get("skipped", [])
    out["samples"] = sorted(({"row": row + first_row, "input": text} for _, row, _, text in marks["samples"]), key=lambda r: r["row"])
    return out


def profile(records: DataFrame, first_row: int = 2, folder: str | None = None) -> dict:
    """The whole report on records(row_index and the three fields); its state stays in the folder, if one is given."""
    return report(state(records, folder), first_row)
