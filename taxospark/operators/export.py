"""Round-trip exports: a file's own columns, then codes, probabilities and titles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from taxospark.functions.text import formula_safe, slug
from taxospark.operators.taxonomy import is_small, with_title
from taxospark.schemas import FIELDS, LEVELS, Layout, SpecError

LEGACY = ("row_index", *FIELDS, "school_name", "school_year_enrolled")
TOP = 5


def unique_rows(courses: DataFrame) -> DataFrame:
    """One row per content_hash with the fields of its first row, and first_row."""
    return courses.groupBy("content_hash").agg(*(F.min_by(f, "row_index").alias(f) for f in FIELDS), F.min("row_index").alias("first_row"))


def source_columns(layout: Layout | None, unique: bool = False) -> tuple[list[str], list[Column]]:
    """Header and cells of the records' own part. A header may hold a name twice, so cells have names of their own, c0 on."""
    if unique:
        return list(FIELDS), [formula_safe(F.col(f)) for f in FIELDS]
    if layout is None:
        return list(LEGACY), [F.col(c) if c == "row_index" else formula_safe(F.col(c)) for c in LEGACY]
    fields = dict(zip(layout.mapping.positions(), FIELDS))
    cells = [F.col(fields[i]) if i in fields else F.try_element_at("extra_columns", F.lit(str(i))) for i in range(len(layout.headers))]
    return list(layout.headers), [formula_safe(c) for c in cells]


def with_codes(df: DataFrame, results: DataFrame, taxonomy: DataFrame, models: Sequence[tuple[int, int]], top: bool = False) -> tuple[DataFrame, list[str]]:
    """df with each level's code, probability and title columns, and their names; models: (level, model_id), ascending.

    Each level is one left join on content_hash; titles are broadcast joins. Level 4 has no title columns.
    """
    levels = [level for level, _ in models]
    if not models or len(set(levels)) < len(levels) or not set(levels) <= set(LEVELS):
        raise SpecError("name one model for each of the levels 2, 4 and 6 at most")
    names: list[str] = []
    fits = is_small(taxonomy)
    for level, model in sorted(models):
        head = f"ccm{level}digit"
        found = {f"{head}_code": F.col("classification"), f"{head}_prob": F.col("probability")}
        titled = {f"{head}_code": f"{head}_title"}
        if top:
            for k in range(1, TOP + 1):
                found |= {f"{head}_code{k}": F.col("classification" if k == 1 else f"top{k}_code"), f"{head}_prob{k}": F.col("probability" if k == 1 else f"top{k}_prob")}
                titled[f"{head}_code{k}"] = f"{head}_title{k}"
        df = df.join(results.filter(F.col("model_id") == model).select("content_hash", *(c.alias(n) for n, c in found.items())), "content_hash", "left")
        for name in found:
            names.append(name)
        if level != 4:
            for code, title in titled.items():
                df = with_title(df, taxonomy, code, level, title, fits)
                names.insert(names.index(code.replace("_code", "_prob")) + 1, title)
        for name in names:
            if name.startswith(head) and "_prob" not in name:
                df = df.withColumn(name, formula_safe(F.col(name)))
    return df, names


def export(courses: DataFrame, results: DataFrame, taxonomy: DataFrame, models: Sequence[tuple[int, int]], layout: Layout | None = None, unique: bool = False, top: bool = False) -> tuple[list[str], DataFrame]:
    """(header, rows in order) of an export. The rows' columns are c0, c1, ... for the records' own part, then by name."""
    rows = unique_rows(courses) if unique else courses
    order = "first_row" if unique else "row_index"
    coded, names = with_codes(rows, results, taxonomy, models, top)
    header, cells = source_columns(layout, unique)
    own = [c.alias(f"c{i}") for i, c in enumerate(cells)]
    return [*header, *names], coded.orderBy(order).select(*own, *names)


def write_csv(header: Sequence[str], rows: DataFrame, path: str, compressed: int = 0) -> int:
    """Writes ordered part files under path, each with the header line, repeated names and all; returns the number of rows.

    The header is laid over the rows' names, for a file may name two columns alike. Order runs over the part files. Cells
    keep white space at their ends. Where `compressed` is given, files are compressed by gzip and have so many rows at most,
    for such a file is read by one task.
    """
    seen = Observation()
    plain = rows.select(*(F.col(c).cast("string") for c in rows.columns)).observe(seen, F.count("*").alias("n"))
    if len(set(map(str.lower, header))) == len(header):
        writer = plain.toDF(*header).write.option("header", True).option("escape", '"').option("emptyValue", "")
        if compressed:
            writer = writer.option("compression", "gzip").option("maxRecordsPerFile", compressed)
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif compressed:
        raise SpecError("files of repeated names aren't compressed")
    else:
        _write_repeated(header, plain, path)
    return int(seen.get["n"])


def _write_repeated(header: Sequence[str], rows: DataFrame, path: str) -> None:
    """Spark refuses a header with repeated names, so the lines are made here and written as text, the header first in each part."""
    quoted = lambda c: F.when(c.isNull(), "").when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *(quoted(F.col(c)) for c in rows.columns)).alias("value")
    first = ",".join('"' + h.replace('"', '""') + '"' if any(x in h for x in '",\r\n') else h for h in header)

    def headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [first]})
        for b in batches:  # a stream's batches have one schema, and the lines' own says that none is null
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    rows.select(line).mapInArrow(headed, "value string").write.text(path)


def file_name(title: str, levels: Sequence[int], unique: bool = False) -> str:
    base = f"{slug(title)}-{levels[0]}-digit" if len(levels) == 1 else f"{slug(title)}-ccm-all-levels"
    return f"{base}{'-unique' if unique else ''}.csv"
