"""Row checks of the profiler: predicates over trimmed, importable rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxospark.functions.text import ascii_lower

WARN, NOTE = "warning", "info"


@dataclass(frozen=True)
class Check:
    """A check's report entry. threshold: share of importable rows from which it is a finding; None: of the dataset."""

    code: str
    field: str
    severity: str
    threshold: float | None


# The checks in report order.
CHECKS = (
    Check("catalog_has_subject_prefix", "catalog", WARN, 0.05),
    Check("subject_has_number", "subject", WARN, 0.05),
    Check("catalog_numeric_coerced", "catalog", WARN, 0.01),
    Check("catalog_no_digits", "catalog", WARN, 0.05),
    Check("catalog_has_whitespace", "catalog", WARN, 0.05),
    Check("catalog_too_long", "catalog", WARN, 0.05),
    Check("catalog_low_cardinality", "catalog", WARN, None),
    Check("subject_too_long", "subject", WARN, 0.05),
    Check("subject_high_cardinality", "subject", WARN, None),
    Check("title_no_letters", "title", WARN, 0.05),
    Check("title_too_long", "title", WARN, 0.05),
    Check("title_repeats_code", "title", WARN, 0.05),
    Check("title_short", "title", WARN, 0.10),
    Check("catalog_short", "catalog", NOTE, 0.05),
    Check("subject_lowercase", "subject", NOTE, 0.50),
    Check("title_mixed_case", "title", NOTE, 0.50),
    Check("encoding_damage", "row", NOTE, 0.0),
    Check("inner_whitespace_runs", "row", NOTE, 0.01),
)
ROW_CHECKS = tuple(c.code for c in CHECKS if c.threshold is not None)
#: Of the dataset checks: importable rows from which they apply, and their bounds.
CARDINALITY_ROWS, LOW_CARDINALITY, HIGH_CARDINALITY = 1000, 5, 0.5


def row_checks(subject: Column, catalog: Column, title: Column) -> dict[str, Column]:
    """The predicate of every row check."""
    any_of = lambda test: test(subject) | test(catalog) | test(title)
    low_subject, low_catalog = ascii_lower(subject), ascii_lower(catalog)
    repeats = (F.length(subject) >= 2) & (F.octet_length(catalog) > F.octet_length(subject)) & F.startswith(low_catalog, low_subject)
    return {
        "catalog_has_subject_prefix": repeats | catalog.rlike("^[A-Za-z]{2,}[ -]?[0-9]"),
        "subject_has_number": subject.rlike("[0-9]{2}"),
        "catalog_numeric_coerced": catalog.rlike(r"^[0-9]+\.0+$|^[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"),
        "catalog_no_digits": ~catalog.rlike("[0-9]"),
        "catalog_has_whitespace": catalog.rlike(r"\p{IsWhite_Space}"),
        "catalog_too_long": F.length(catalog) > 8,
        "subject_too_long": F.length(subject) > 8,
        "title_no_letters": ~title.rlike(r"\p{IsAlphabetic}"),
        "title_too_long": F.length(title) > 100,
        "title_repeats_code": F.startswith(ascii_lower(title), F.concat(low_subject, F.lit(" "), low_catalog)),
        "title_short": F.length(title) <= 3,
        "catalog_short": F.length(catalog) <= 2,
        "subject_lowercase": subject.rlike(r"\p{IsLowercase}"),
        "title_mixed_case": title.rlike(r"\p{IsLowercase}"),
        "encoding_damage": any_of(lambda c: F.contains(c, F.lit("�"))),
        "inner_whitespace_runs": any_of(lambda c: c.rlike(r"  |[\t\r\n]")),
    }
