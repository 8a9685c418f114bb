"""Derived datasets: filter, merge with columns mapped, and drop repeated keys."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxospark.operators import explore, filters, profiling
from taxospark.operators.maintenance import check_idle
from taxospark.operators.ranking import first_per, numbered
from taxospark.operators.store import Store, layout_text, replacing, request_text
from taxospark.schemas import (
    FIELDS,
    MAX_SOURCES,
    PREVIEW_ROWS,
    SOURCE_COLUMN,
    ColumnMap,
    DeriveRequest,
    Layout,
    OutputColumn,
    Source,
    SpecError,
)


def check_sources(ids: Sequence[str], known: Mapping[str, Source]) -> list[Source]:
    if not ids:
        raise SpecError("choose at least one source dataset")
    if len(ids) > MAX_SOURCES:
        raise SpecError(f"at most {MAX_SOURCES} sources")
    for i, name in enumerate(ids):
        if name in ids[:i]:
            raise SpecError(f"{name} is listed twice")
        if name not in known:
            raise SpecError(f"{name} no longer exists")
        if known[name].state != "ready":
            raise SpecError(f"{known[name].title or name} isn't ready")
        if known[name].layout is None:
            raise SpecError(f"{known[name].title or name} was imported before column layouts were stored")
    return [known[name] for name in ids]


def default_columns(sources: Sequence[Source], keep: str = "all") -> list[OutputColumn]:
    """The sources' unmapped columns merged by key, in order of first sight and with its spelling; keep="common": those all sources have."""
    found: dict[str, tuple[str, list[tuple[str, int]]]] = {}
    for s in sources:
        for key, at in s.layout.keys().items():
            name = s.layout.headers[at].strip()
            shown = name + key[len(name) :] if key.startswith(name.lower() + " #") else name
            found.setdefault(key, (shown, []))[1].append((s.id, at))
    return [OutputColumn(name, tuple(origins)) for name, origins in found.values() if keep != "common" or len(origins) == len(sources)]


def check_columns(request: DeriveRequest, sources: Sequence[Source]) -> None:
    """Names are given, unique whatever their case and not reserved; origins are real, unmapped, used once and one a source."""
    by_id, taken, used = {s.id: s for s in sources}, set(), set()
    for name in (*request.names, *(c.name for c in request.columns)):
        plain = name.strip().lower()
        if not plain:
            raise SpecError("every column needs a name")
        if plain == SOURCE_COLUMN:
            raise SpecError(f"{SOURCE_COLUMN} is reserved")
        if plain in taken:
            raise SpecError(f"two columns are both named {name.strip()}")
        taken.add(plain)
    for column in request.columns:
        if not column.origins:
            raise SpecError(f"{column.name} has no source column")
        if len({s for s, _ in column.origins}) < len(column.origins):
            raise SpecError(f"{column.name} takes two columns of one source")
        for source, at in column.origins:
            if source not in by_id:
                raise SpecError(f"{source} isn't a source")
            if at not in by_id[source].layout.unmapped():
                raise SpecError(f"{source} doesn't have column {at}")
            if (source, at) in used:
                raise SpecError(f"column {at} of {source} feeds two columns")
            used.add((source, at))


@dataclass(frozen=True)
class Plan:
    """A checked request. Extra columns have places 3 on; the source's title, where there are several, comes last."""

    request: DeriveRequest
    sources: list[Source]
    layout: Layout

    @property
    def tagged(self) -> bool:
        return len(self.sources) > 1


def plan(request: DeriveRequest, known: Mapping[str, Source]) -> Plan:
    sources = check_sources(request.sources, known)
    check_columns(request, sources)
    filters.cleaned(request.filter)
    names = [n.strip() for n in (*request.names, *(c.name for c in request.columns))]
    if len(sources) > 1:
        names.append(SOURCE_COLUMN)
    if request.dedupe is not None:
        if not request.dedupe:
            raise SpecError("choose at least one column to compare")
        for name in request.dedupe:
            if name not in names:
                raise SpecError(f"{name} isn't a column of the result")
    return Plan(request, sources, Layout(tuple(names), ColumnMap(0, 1, 2)))


def _extras(p: Plan, source: Source) -> Column:
    """The map of new places to cells: a place is there with a null where the source has the column but the row has no cell; null where a source gives nothing."""
    pairs: list[Column] = []
    for k, column in enumerate(p.request.columns):
        for s, at in column.origins:
            if s == source.id:
                pairs += [F.lit(str(3 + k)), F.try_element_at("extra_columns", F.lit(str(at)))]
    if p.tagged:
        pairs += [F.lit(str(3 + len(p.request.columns))), F.lit(source.title)]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.lit(None).cast("map<string,string>")


def merged(p: Plan, courses: DataFrame, results: DataFrame | None = None, model_for: Mapping[int, int] = {}) -> DataFrame:  # noqa: B006
    """The filtered rows of all sources with src_pos and their extra columns at new places; content_hash is carried, so cached results apply at once."""
    kept = filters.apply(courses, p.request.filter, p.sources, results, model_for)
    parts = [
        kept.filter(F.col("dataset_id") == s.id).select(F.lit(i).alias("src_pos"), "dataset_id", "row_index", *FIELDS, _extras(p, s).alias("extra_columns"), "content_hash")
        for i, s in enumerate(p.sources)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cell(p: Plan, name: str) -> Column:
    """A column of the derived dataset by its name."""
    at = p.layout.headers.index(name)
    if at < 3:
        return F.col(FIELDS[at])
    return F.col("dataset_id") if p.tagged and name == SOURCE_COLUMN else F.try_element_at("extra_columns", F.lit(str(at)))


def deduped(p: Plan, rows: DataFrame) -> DataFrame:
    """The first row of each key in source order. Keys are compared as they are: case counts, null is not the empty text, and equal to null."""
    if p.request.dedupe is None:
        return rows
    keys = [cell(p, n) for n in p.request.dedupe]
    named = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    return first_per(named, names, ["src_pos", "row_index"]).drop(*names)


def source_counts(p: Plan, rows: DataFrame) -> DataFrame:
    return explore.match_counts(rows, [s.id for s in p.sources])


def preview(rows: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    return rows.orderBy("src_pos", "row_index").limit(limit)


def materialized(p: Plan, rows: DataFrame, dataset_id: str) -> DataFrame:
    """Course rows of the new dataset, numbered from 0 in source order."""
    return numbered(deduped(p, rows).withColumnRenamed("row_index", "_old"), ["src_pos", "_old"]).select(
        F.lit(dataset_id).alias("dataset_id"), "row_index", *FIELDS, "extra_columns", "content_hash"
    )


def materialize(store: Store, request: DeriveRequest, dataset_id: str, title: str, model_for: Mapping[int, int] = {}) -> int:  # noqa: B006
    """Makes a derived dataset: its records, profile, sources and request are stored, and its state goes from importing to ready or failed.

    The profile of all rows of sources whose profiles have a stored state is put together from those states. The sources
    and the new dataset must be idle. Returns its rows.
    """
    p = plan(request, store.sources())
    check_idle(store.datasets().filter(F.col("id").isin(dataset_id, *request.sources)))
    if dataset_id in request.sources:
        raise SpecError(f"{dataset_id} can't be made from itself")
    entry = {"id": dataset_id, "title": title, "source_kind": "derived", "layout": layout_text(p.layout), "derivation": request_text(request)}
    with replacing(store, entry):
        version = store.store_courses(materialized(p, merged(p, store.courses(*request.sources), store.results(), model_for), dataset_id))
        n = store.written[version][0]
        states = [store.profile_state(s.id) for s in p.sources] if not request.filter.rows and request.dedupe is None else []
        if states and all(states):
            told = profiling.report(profiling.merged(states, store.profile_folder(version)))
        else:
            told = profiling.profile(store.stored(version).select("row_index", *FIELDS), 2, store.profile_folder(version))
        report = json.dumps(told, default=str)
        store.set_sources(dataset_id, p.sources)
        store.name_courses(dataset_id, version)
        store.add_dataset(**entry, import_state="ready", row_count=n, profile=report, imported_at=datetime.now())
    return n


def lineage(dataset_sources: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset_id, position, source_dataset_id, source_title, exists): a derived dataset's sources, which may be gone."""
    there = datasets.select(F.col("id").alias("source_dataset_id"), F.lit(True).alias("_there"))
    return dataset_sources.join(there, "source_dataset_id", "left").select("dataset_id", "position", "source_dataset_id", "source_title", F.col("_there").isNotNull().alias("exists"))
