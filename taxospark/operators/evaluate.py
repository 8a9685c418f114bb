"""Evaluation: label agreement, sensitivity to damaged input, parity of two scorers, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxospark.functions.codes import match, numeric
from taxospark.functions.logits import argmax, top
from taxospark.functions.text import assembled, content_hash, title_case
from taxospark.operators import export
from taxospark.operators.scoring import Scorer, as_results, scored
from taxospark.schemas import FIELDS

ARGMAX_LEAST, DIFFERENCE_MOST, STRICT_DIFFERENCE = 0.95, 1e-3, 5e-5


def agreement(rows: DataFrame, predicted: str, truth: str, level: int) -> DataFrame:
    """(compared, matched, skipped, rate): labels that don't parse are skipped."""
    told = numeric(F.col(truth), level).isNotNull()
    hit = match(F.col(predicted), F.col(truth), level)
    compared, matched = F.count_if(told), F.count_if(told & hit)
    return rows.agg(compared.alias("compared"), matched.alias("matched"), F.count_if(~told).alias("skipped"), F.when(compared > 0, matched / compared).alias("rate"))


def disagreements(rows: DataFrame, predicted: str, truth: str, level: int) -> DataFrame:
    """The rows whose prediction isn't the label, with both as numbers."""
    x, y = numeric(F.col(predicted), level), numeric(F.col(truth), level)
    return rows.filter(y.isNotNull() & ~match(F.col(predicted), F.col(truth), level)).withColumns({"predicted_number": x, "truth_number": y})


def write_disagreements(rows: DataFrame, predicted: str, truth: str, level: int, path: str) -> int:
    """Writes the log of disagreements as CSV part files under path, with a header in each; returns its rows."""
    found = disagreements(rows, predicted, truth, level)
    flat = [F.to_json(c).alias(c) if isinstance(found.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(c) for c in found.columns]
    return export.write_csv(found.columns, found.select(*flat), path)


def broadcast_back(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every row with the prediction of its text: one prediction a content_hash serves all that share it."""
    return rows.join(predictions, "content_hash")


def label_agreement(rows: DataFrame, truth: str, level: int, labels: Sequence[str], make: Callable[[], Scorer]) -> DataFrame:
    """The agreement of a model's codes with a label column of rows(row_index, fields, truth): each distinct text is scored once.

    Another backend is checked by another `make` over the same rows.
    """
    hashed = rows.withColumn("content_hash", content_hash(*(F.col(f) for f in FIELDS)))
    distinct = hashed.groupBy("content_hash").agg(F.min_by(assembled(*(F.col(f) for f in FIELDS)), "row_index").alias("input"))
    told = as_results(scored(distinct, make), labels, 0, level).select("content_hash", F.col("classification").alias("predicted"))
    return agreement(broadcast_back(hashed, told), "predicted", truth, level)


def dedup_ratio(rows: DataFrame) -> DataFrame:
    """(total, distinct, ratio): the share of rows that repeat an earlier text."""
    per_hash = rows.groupBy("content_hash").agg(F.count("*").alias("n"))
    return per_hash.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).withColumn("ratio", F.when(F.col("total") > 0, 1 - F.col("distinct") / F.col("total")))


def latency(samples: DataFrame, column: str) -> DataFrame:
    """(p50, p95), interpolated between neighbours."""
    return samples.agg(F.percentile(column, F.array(F.lit(0.5), F.lit(0.95))).alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key: the same ones each time."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


# The report's labels of damaged forms, in its order.
FORMS = (
    "baseline",
    "subject repeated in catalog (`PSYC 4325`)",
    "subject repeated in catalog, no space (`PSYC4325`)",
    "full code in both subject and catalog",
    "catalog as converted number (`4325.0`)",
    "catalog letters stripped (`4304L` -> `4304`)",
    "catalog missing",
    "subject missing",
    "title missing",
    "title only",
    "subject and catalog swapped",
    "title in the catalog column",
    "catalog is a year (`2024`)",
    "subject lowercased",
    "title in Title Case",
    "title lowercased",
    "trailing whitespace kept",
    "title prefixed with the code",
)


def variants(s: Column, c: Column, t: Column) -> dict[str, tuple[Column, Column, Column]]:
    """The damaged forms of an input, by their labels: what stands in place of the subject, catalog number and title; baseline is the input itself."""
    gone, own = F.lit(""), {"s": s, "c": c, "t": t}
    code = F.concat_ws(" ", s, c)
    edits: list[dict[str, Column]] = [
        {}, {"c": code}, {"c": F.concat(s, c)}, {"s": code, "c": code}, {"c": F.concat(c, F.lit(".0"))}, {"c": F.regexp_replace(c, r"[^\p{Nd}]", "")},
        {"c": gone}, {"s": gone}, {"t": gone}, {"s": gone, "c": gone}, {"s": c, "c": s}, {"c": t, "t": c}, {"c": F.lit("2024")}, {"s": F.lower(s)}, {"t": title_case(t)}, {"t": F.lower(t)},
        {f: F.concat(x, F.lit(" " * n)) for n, (f, x) in enumerate(own.items(), 2)}, {"t": F.concat_ws(" ", code, t)},
    ]
    return {label: tuple((own | edit).values()) for label, edit in zip(FORMS, edits, strict=True)}


def perturbed(rows: DataFrame, keep: Sequence[str] = ("row_index",), names: Sequence[str] | None = None) -> DataFrame:
    """(*keep, variant, input): every row in every damaged form."""
    forms = variants(F.col("subject_code"), F.col("catalog_number"), F.col("course_title"))
    each = [F.struct(F.lit(n).alias("variant"), assembled(*f).alias("input")) for n, f in forms.items() if names is None or n in names]
    return rows.select(*keep, F.inline(F.array(*each)))


def sensitivity(predictions: DataFrame, keys: Sequence[str] = ("row_index",), level: int | None = None) -> DataFrame:
    """(variant, n, flip_rate, mean_prob) of predictions(*keys, variant, code, prob): how often a form's code isn't the baseline's.

    With a level, predictions have a column truth, the row's own code, and agreement is how often a form's code matches it.

    The baseline's code reaches the others of its row by one grouping, not by a self-join.
    """
    base = F.max(F.when(F.col("variant") == "baseline", F.col("code"))).alias("base")
    grouped = predictions.groupBy(*keys).agg(base, F.collect_list(F.struct("variant", "code", "prob", *(["truth"] if level else []))).alias("forms"))
    flat = grouped.select("base", F.inline("forms"))  # a row has a bounded number of forms
    agreement = [F.avg(match(F.col("code"), F.col("truth"), level).cast("double")).alias("agreement")] if level else []
    flips = F.avg((F.col("code") != F.col("base")).cast("double")).alias("flip_rate")
    return flat.groupBy("variant").agg(F.count("*").alias("n"), flips, F.avg("prob").alias("mean_prob"), *agreement)


def parity(a: DataFrame, b: DataFrame, key: str, column: str = "logits") -> DataFrame:
    """(n, argmax_rate, top3_rate, max_diff, mean_diff, passed, passed_strict) of two tables of logits."""
    both = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    diffs = F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    ids = lambda c: F.array_sort(F.transform(top(F.col(c), 3), lambda z: z["i"]))
    one = both.select((argmax(F.col("x")) == argmax(F.col("y"))).alias("same"), (ids("x") == ids("y")).alias("same3"), F.array_max(diffs).alias("most"), (F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d) / F.size("x")).alias("mean"))
    rate = F.avg(F.col("same").cast("double"))
    out = one.agg(F.count("*").alias("n"), rate.alias("argmax_rate"), F.avg(F.col("same3").cast("double")).alias("top3_rate"), F.max("most").alias("max_diff"), F.avg("mean").alias("mean_diff"))
    good = F.col("argmax_rate") >= ARGMAX_LEAST
    return out.withColumns({"passed": good & (F.col("max_diff") <= DIFFERENCE_MOST), "passed_strict": good & (F.col("max_diff") <= STRICT_DIFFERENCE)})


def markdown(summary: DataFrame, title: str, limit: int = 1000) -> str:
    """A small summary as a Markdown table."""
    rows = summary.limit(limit).collect()
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
