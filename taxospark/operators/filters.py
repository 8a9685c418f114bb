"""Typed filters over records: checked before a job starts, then applied as predicates and semi-joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxospark.functions.text import normalized
from taxospark.schemas import FIELDS, LEVELS, MAX_FILTER_ROWS, MAX_FILTER_VALUES, FilterRow, FilterSpec, Op, Source, SpecError

VALUELESS = (Op.IS_EMPTY, Op.IS_NOT_EMPTY)


def cleaned(spec: FilterSpec) -> FilterSpec:
    """The spec with blank values dropped, once it is known to be valid."""
    if len(spec.rows) > MAX_FILTER_ROWS:
        raise SpecError(f"a filter has at most {MAX_FILTER_ROWS} rows")
    out = []
    for row in spec.rows:
        op = Op(row.op)
        values = tuple(v for v in row.values if v.strip())
        if len(row.values) > MAX_FILTER_VALUES:
            raise SpecError(f"a filter row has at most {MAX_FILTER_VALUES} values")
        if op in VALUELESS and row.values:
            raise SpecError(f"{op} takes no values")
        if op not in VALUELESS and not values:
            raise SpecError(f"{op} needs a value")
        if row.field.startswith("code:"):
            if row.field[5:] not in map(str, LEVELS):
                raise SpecError(f"there is no code level {row.field[5:]}")
            if op in VALUELESS:
                raise SpecError("a code filter needs values")
        elif row.field == "source":
            if op not in (Op.IS, Op.IS_NOT):
                raise SpecError("a source filter is is or isNot")
        elif row.field not in FIELDS and not row.field.startswith("column:"):
            raise SpecError(f"unknown field {row.field}")
        out.append(FilterRow(row.field, op, values))
    return FilterSpec(tuple(out))


def predicate(value: Column, op: Op, values: Sequence[str]) -> Column:
    """The condition on one text, null counting as empty. Values match literally, any of them, whatever their case."""
    text = normalized(value)
    wanted = [v.strip().lower() for v in values]
    if op in VALUELESS:
        return (text == "") if op is Op.IS_EMPTY else (text != "")
    if op in (Op.IS, Op.IS_NOT):
        hit = text.isin(wanted)
    elif op in (Op.CONTAINS, Op.NOT_CONTAINS):
        hit = reduce(or_, (F.contains(text, F.lit(v)) for v in wanted))
    else:
        hit = reduce(or_, (F.startswith(text, F.lit(v)) for v in wanted))
    return ~hit if op in (Op.IS_NOT, Op.NOT_CONTAINS) else hit


def column_cell(key: str, sources: Sequence[Source]) -> Column:
    """The cell of the column with this key, which each source has at a place of its own, or not at all."""
    places = {s.id: s.layout.keys()[key] for s in sources if s.layout and key in s.layout.keys()}
    if not places:
        raise SpecError(f"no source has a column {key}")
    cells = [F.when(F.col("dataset_id") == i, F.try_element_at("extra_columns", F.lit(str(at)))) for i, at in places.items()]
    return F.coalesce(*cells)


def apply(
    courses: DataFrame,
    spec: FilterSpec,
    sources: Sequence[Source],
    results: DataFrame | None = None,
    model_for: Mapping[int, int] | Callable[[int], int | None] = {},  # noqa: B006
) -> DataFrame:
    """The rows of courses, of these sources, that meet every condition.

    A condition on codes keeps rows that have a result at that level whose code meets it, so "is not" needs a result
    too; it is a semi-join on content_hash. All others are predicates, evaluated with the scan.
    """
    active = model_for.get if isinstance(model_for, Mapping) else model_for
    tests: list[Column] = [F.col("dataset_id").isin([s.id for s in sources])]
    semis: list[DataFrame] = []
    for row in cleaned(spec).rows:
        if row.field == "source":
            if len(sources) < 2:
                raise SpecError("a source filter needs two sources")
            hit = F.col("dataset_id").isin(list(row.values))
            tests.append(hit if row.op is Op.IS else ~hit)
        elif row.field.startswith("code:"):
            model = active(int(row.field[5:]))
            if model is None or results is None:
                raise SpecError(f"there is no active model for level {row.field[5:]}")
            semis.append(results.filter((F.col("model_id") == model) & predicate(F.col("classification"), row.op, row.values)).select("content_hash"))
        elif row.field.startswith("column:"):
            tests.append(predicate(column_cell(row.field[7:], sources), row.op, row.values))
        else:
            tests.append(predicate(F.col(row.field), row.op, row.values))
    out = courses.filter(reduce(and_, tests))
    return reduce(lambda df, semi: df.join(semi, "content_hash", "left_semi").select(*courses.columns), semis, out)


def importable(subject: Column, catalog: Column, title: Column) -> Column:
    """Whether none of the (trimmed) fields is blank."""
    return reduce(and_, (F.coalesce(c, F.lit("")) != "" for c in (subject, catalog, title)))
