"""Titles of codes, and searches of the taxonomy."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxospark.functions.codes import family
from taxospark.functions.text import folded

#: Rows of a taxonomy from which it is no longer broadcast (published taxonomies have some thousands).
BROADCAST_ROWS = 100_000


def is_small(taxonomy: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether it has no more than `rows` rows, and so may be broadcast."""
    return taxonomy.limit(rows + 1).count() <= rows


def with_title(df: DataFrame, taxonomy: DataFrame, code: str, level: int, title: str, fits: bool | None = None) -> DataFrame:
    """df with the title of its code: the code's own, else its two-digit parent's. At level 4 there are no titles but the code's own.

    fits: whether the taxonomy may be broadcast, where the caller knows; else it is looked up.
    """
    small = F.broadcast if (is_small(taxonomy) if fits is None else fits) else lambda t: t
    own = taxonomy.filter(F.col("digit_level") == level).select(F.col("code").alias(code), F.col("title").alias("_own"))
    if level == 4:
        return df.join(small(own), code, "left").withColumnRenamed("_own", title)
    parent = taxonomy.filter("digit_level = 2").select(F.col("code").alias("_parent"), F.col("title").alias("_parent_title"))
    return (
        df.join(small(own), code, "left")
        .withColumn("_parent", family(F.col(code)))
        .join(small(parent), "_parent", "left")
        .withColumn(title, F.coalesce("_own", "_parent_title"))
        .drop("_own", "_parent", "_parent_title")
    )


def listed(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.orderBy("code")


def families(taxonomy: DataFrame) -> DataFrame:
    return listed(taxonomy.filter("digit_level = 2"))


def search(taxonomy: DataFrame, query: str, code: bool = True, title: bool = True, description: bool = True, limit: int | None = 200) -> DataFrame:
    """Entries that match every term: a numeric one the start of the code, dots aside, any other a part of the text. No terms: none."""
    plain = query.lower().translate(str.maketrans("‘’“”–—", "''\"\"--")).replace("…", "...")
    digits = F.replace(F.col("code"), F.lit("."), F.lit(""))
    parts = [F.coalesce(F.col(c), F.lit("")) for c, on in (("title", title), ("description", description)) if on]
    text = folded(F.concat_ws("\n", *parts)) if parts else F.lit("")

    def hit(term: str) -> Column:
        if re.fullmatch(r"[0-9.]+", term):
            return F.startswith(digits, F.lit(term.replace(".", ""))) if code else F.lit(False)
        return F.contains(text, F.lit(term))

    terms = plain.split()
    found = listed(taxonomy.filter(reduce(and_, map(hit, terms), F.lit(bool(terms)))))
    return found if limit is None else found.limit(limit)


def related(taxonomy: DataFrame, code: str) -> DataFrame:
    """Of a two-digit code all its six-digit codes; of a six-digit one the others of its four-digit group."""
    prefix = f"{code}." if len(code) == 2 else code[:5]
    return listed(taxonomy.filter((F.col("digit_level") == 6) & F.startswith(F.col("code"), F.lit(prefix)) & (F.col("code") != code)))
