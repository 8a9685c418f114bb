"""Hierarchical codes: canonical form, numeric comparison, parents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(label: Column, level: Column | int) -> Column:
    """XX, XX.XX or XX.XXXX by the level, from labels that lost zeros as numbers; never shortened."""
    level = F.lit(level) if isinstance(level, int) else level
    whole = F.substring_index(label, ".", 1)
    part = F.when(F.contains(label, F.lit(".")), F.regexp_replace(label, r"^[^.]*\.", "")).otherwise(F.lit(""))
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(2) - F.length(whole))), whole)
    size = F.when(level == 4, 2).when(level == 6, 4).otherwise(0)
    return F.when(size == 0, padded).otherwise(F.concat(padded, F.lit("."), part, F.repeat(F.lit("0"), F.greatest(F.lit(0), size - F.length(part)))))


def numeric(code: Column, level: int) -> Column:
    """A code as a number: dotted codes as they are, bare digits with the level's implied point; null for none."""
    text = F.trim(code)
    bare = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")) / F.lit(float(10 ** (level - 2)))
    return F.when((text == "") | F.lower(text).isin("nan", "none"), F.lit(None)).when(F.contains(text, F.lit(".")), text.try_cast("double")).otherwise(bare)


def match(a: Column, b: Column, level: int) -> Column:
    """Whether both parse and agree as numbers."""
    x, y = numeric(a, level), numeric(b, level)
    near = F.abs(x - y) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-9))
    return F.coalesce(near, F.lit(False))


def family(code: Column) -> Column:
    return F.substring(code, 1, 2)


def group(code: Column) -> Column:
    return F.substring(code, 1, 5)
