"""Types of the data model: layouts, sources, specs and the fixed values they are checked against."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T

FIELDS = ("subject_code", "catalog_number", "course_title")
LEVELS = (2, 4, 6)

COURSES = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
        *(T.StructField(f, T.StringType()) for f in FIELDS),
        T.StructField("extra_columns", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hash", T.StringType()),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("model_id", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("probability", T.FloatType()),
        T.StructField("logit_argmax", T.FloatType()),
        *(T.StructField(f"top{k}_{x}", t) for k in range(2, 6) for x, t in (("code", T.StringType()), ("prob", T.FloatType()))),
        T.StructField("computed_at", T.TimestampType()),
    ]
)
TAXONOMY = T.StructType(
    [
        T.StructField("digit_level", T.ByteType()),
        T.StructField("code", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_short", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# Header names that mark the three fields, in order of preference.
SUBJECT_ALIASES = ("subject_code", "sub_pref", "subject", "subj", "dept", "department")
CATALOG_ALIASES = ("catalog_number", "course", "course_number", "number", "cat_no", "catalog")
TITLE_ALIASES = ("course_title", "title", "inventory_course_title", "name", "course_name")

# Limits.
MAX_COLUMNS = 256
MAX_FIELD_BYTES = 8192
MAX_FILTER_ROWS = 64
MAX_FILTER_VALUES = 256
MAX_SOURCES = 32
MAX_PAGE = 500
PREVIEW_ROWS = 50
PICKER_VALUES = 100
SOURCE_COLUMN = "source_dataset"


class SpecError(ValueError):
    """A request that can't be run, found before any job starts."""


@dataclass(frozen=True)
class ColumnMap:
    """Positions of the three fields in a file's header."""

    subject: int
    catalog: int
    title: int

    def positions(self) -> tuple[int, int, int]:
        return self.subject, self.catalog, self.title


@dataclass(frozen=True)
class Layout:
    """A file's header and mapping. Unmapped cells are kept by position, as header names may repeat."""

    headers: tuple[str, ...]
    mapping: ColumnMap

    def __post_init__(self) -> None:
        places = self.mapping.positions()
        if len(set(places)) < 3 or not all(0 <= p < len(self.headers) for p in places):
            raise SpecError(f"the mapping {places} needs three different columns of {len(self.headers)}")

    def unmapped(self) -> list[int]:
        return [i for i in range(len(self.headers)) if i not in self.mapping.positions()]

    def keys(self) -> dict[str, int]:
        """Each unmapped column's key and position: the header trimmed and lowered, numbered where it repeats."""
        keys: dict[str, int] = {}
        seen: dict[str, int] = {}
        for i in self.unmapped():
            name = self.headers[i].strip().lower()
            seen[name] = n = seen.get(name, 0) + 1
            keys[name if n == 1 else f"{name} #{n}"] = i
        return keys


@dataclass(frozen=True)
class Source:
    """A dataset that a query reads: its id, title, layout and state."""

    id: str
    title: str = ""
    layout: Layout | None = None
    state: str = "ready"


class Op(StrEnum):
    IS = "is"
    IS_NOT = "isNot"
    CONTAINS = "contains"
    NOT_CONTAINS = "notContains"
    STARTS_WITH = "startsWith"
    IS_EMPTY = "isEmpty"
    IS_NOT_EMPTY = "isNotEmpty"


@dataclass(frozen=True)
class FilterRow:
    """One condition. field: a field's name, `column:<key>`, `source`, or `code:<level>`. Values are alternatives."""

    field: str
    op: Op
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class FilterSpec:
    """Conditions that must all hold; none: all rows."""

    rows: tuple[FilterRow, ...] = ()


@dataclass(frozen=True)
class OutputColumn:
    """A column of a derived dataset; origins: (source id, position) at most once for each source."""

    name: str
    origins: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class DeriveRequest:
    """What a derived dataset is made of."""

    sources: tuple[str, ...]
    columns: tuple[OutputColumn, ...] = ()
    filter: FilterSpec = field(default_factory=FilterSpec)
    names: tuple[str, str, str] = FIELDS
    dedupe: tuple[str, ...] | None = None
