"""Text functions, all built of Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxospark.schemas import MAX_FIELD_BYTES

SPACE_ENDS = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Private-use characters that stand for the classes digit, upper, lower and space.
MARKS, CLASSES = "\ue000\ue001\ue002\ue003", "9Aa_"
SHAPE_LENGTH = 256


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's own trim knows the plain space only."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def normalized(text: Column) -> Column:
    """What filters compare: null as empty, space separators trimmed, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\p{Zs}+|\p{Zs}+$", ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def assembled(subject: Column, catalog: Column, title: Column) -> Column:
    """The text that a model sees; null if any part is."""
    return F.concat(subject, F.lit(" "), catalog, F.lit(" --- "), title)


def content_hash(subject: Column, catalog: Column, title: Column) -> Column:
    return F.sha2(assembled(subject, catalog, title), 256)


def truncated(text: Column, size: int = MAX_FIELD_BYTES) -> Column:
    """At most `size` bytes of UTF-8, cut between characters."""
    data = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(data, 1, size - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*cuts))


def display(text: Column) -> Column:
    return F.substring(text, 1, 200)


def sheet_row(row_index: Column) -> Column:
    """A record's row in a spreadsheet, below the header."""
    return row_index + 2


def formula_safe(text: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe before it."""
    return F.when(text.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def shape(text: Column) -> Column:
    """Each character's class (9, A, a, _ or itself), runs written once with a plus."""
    marked = text
    for pattern, mark in zip((r"[0-9]", r"\p{IsUppercase}", r"\p{IsLowercase}", r"[\p{IsWhite_Space}_]"), MARKS):
        marked = F.regexp_replace(marked, pattern, mark)
    return F.substring(F.translate(F.regexp_replace(marked, r"(?s)(.)\1+", "$1+"), MARKS, CLASSES), 1, SHAPE_LENGTH)


def folded(text: Column) -> Column:
    """Lower case with plain quotes, dashes and dots, as searches compare."""
    return F.replace(F.translate(F.lower(text), "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def title_case(text: Column) -> Column:
    """The first letter of every run of letters upper, the others lower."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def slug(title: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in title).lower()
