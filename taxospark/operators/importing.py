"""Importing files: records as they are, repeated ones too, with the hash of their assembled text."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taxospark.functions.text import content_hash
from taxospark.operators import profiling
from taxospark.operators.filters import importable
from taxospark.operators.maintenance import check_idle
from taxospark.operators.shared import observed, written
from taxospark.operators.store import Store, layout_text, replacing
from taxospark.schemas import COURSES, FIELDS, MAX_FIELD_BYTES, ColumnMap, Layout, SpecError
from taxospark.sources import delimited


def imported(records: DataFrame, dataset_id: str, limit: int | None = None) -> DataFrame:
    """Importable rows of records(row_index, fields, extra_columns). Skipped records leave gaps in row_index; limit counts imported rows only."""
    fields = [F.col(f) for f in FIELDS]
    kept = records.filter(importable(*fields))
    if limit is not None:
        kept = kept.orderBy("row_index").limit(limit)
    return kept.withColumn("dataset_id", F.lit(dataset_id)).withColumn("content_hash", content_hash(*fields)).select(*COURSES.names)


def import_csv(
    spark: SparkSession, store: Store, path: str, dataset_id: str, title: str, mapping: ColumnMap | None = None, encoding: str = delimited.UTF8,
    limit: int | None = None, max_field_bytes: int = MAX_FIELD_BYTES, profile: bool = True,
) -> int:
    """Imports a file, or a folder of files, as a dataset, in place of one with its id; refuses ragged records and bytes that aren't of the encoding.

    Records are parsed once, checked while they are written, and count only when all is well; what was there before stays
    until then. The entry's state is importing meanwhile, then ready or failed, and it gets the header and mapping, the
    time, and the profile of all records, skipped ones too. Refused while the dataset is busy. Returns the rows imported.
    """
    check_idle(store.datasets().filter(F.col("id") == dataset_id))
    names = delimited.headers(spark, path, encoding)
    layout = Layout(names, mapping or delimited.detect_mapping(names))
    digest, size = delimited.source_digest(spark, path)
    entry = {"id": dataset_id, "title": title, "source_kind": "file", "source_file_id": digest, "layout": layout_text(layout)}
    with replacing(store, entry):
        seen = Observation()
        scanned = delimited.scan(spark, path, len(names), encoding)
        checks = [F.count(delimited.CORRUPT).alias("ragged"), F.count_if(delimited.bad_utf8(scanned)).alias("bytes")]
        version = store.store_courses(imported(delimited.courses(scanned.observe(seen, *checks), layout, max_field_bytes), dataset_id, limit))
        try:
            told = observed(seen)
            if told.get("ragged"):
                raise SpecError(f"{told['ragged']} records don't have {len(names)} fields")
            if encoding == delimited.UTF8 and told.get("bytes"):
                raise SpecError(f"{told['bytes']} records aren't UTF-8")
            report = json.dumps(profiling.profile(delimited.courses(scanned, layout, max_field_bytes), 2, store.profile_folder(version)), default=str) if profile else None
        except Exception:
            store.discard_courses(version)
            raise
        n = store.written[version][0]
        store.add_file(digest, path, size)
        store.name_courses(dataset_id, version)
        store.add_dataset(**entry, import_state="ready", row_count=n, profile=report, imported_at=datetime.now())
    return n


def validate(spark: SparkSession, path: str, mapping: ColumnMap | None = None, encoding: str = delimited.UTF8) -> dict:
    """A dry run of an import: what the file is, how many fields would be cut, and the profile of its records."""
    names = delimited.headers(spark, path, encoding)
    layout = Layout(names, mapping or delimited.detect_mapping(names))
    # every part of the report reads the records as they were parsed once
    records = written(delimited.scan(spark, path, len(names), encoding), "validate")
    bad, first = delimited.ragged(records)
    cut = records.agg(F.coalesce(F.sum(delimited.oversized(records, len(names))), F.lit(0))).first()[0]
    shown = records.orderBy("row_index").limit(delimited.PREVIEW).select(*(f"_c{i}" for i in range(len(names))))
    report = {"headers": names, "mapping": layout.mapping, "ragged": bad, "ragged_rows": [tuple(r) for r in first.collect()], "truncated_fields": cut, "preview": [tuple(r) for r in shown.collect()]}
    return report | {"profile": profiling.profile(delimited.courses(records, layout))}
