"""Global numbering and first-per-key, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxospark.operators.shared import free_name, written


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """df with the 0-based place of each row in the order, which must be a total one.

    Rows are dealt out in ranges of the order, sorted, and written once with their place in their range. Ranges are
    planned when rows are written and at no other time, so each row's range is what the files say; the ranges' sizes,
    counted from the files, become offsets that are broadcast, a row for each written partition.
    """
    place, part, before = (free_name(df, c) for c in ("_place", "_part", "_before"))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = written(laid, "numbered").withColumn(part, F.shiftright(place, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), part).select(*df.columns, (F.col(before) + within).cast("long").alias(name))


def first_per(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by the order; null keys equal each other. Ranks above 1 are dropped before the shuffle too."""
    rank = free_name(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)
