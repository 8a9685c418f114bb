"""Reduction of a row's logits, array<float>, to codes and probabilities; native array expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 5


def label_table(labels: dict[int, str]) -> list[str]:
    """Labels by class id; a gap is an error."""
    if sorted(labels) != list(range(len(labels))):
        raise ValueError("class ids must run from 0 without gaps")
    return [labels[i] for i in range(len(labels))]


def denominator(logits: Column) -> Column:
    """Sum of exp(z - max z), in double: the largest class has probability 1 / denominator."""
    top = F.array_max(logits).cast("double")
    return F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z.cast("double") - top))


def argmax(logits: Column) -> Column:
    """0-based; of equal maxima the first."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top(logits: Column, k: int = TOP) -> Column:
    """The k largest as array<struct<rank_key, i>>, ties by class id; class 0 fills up where there are fewer classes."""
    ranked = F.slice(F.array_sort(F.transform(logits, lambda z, i: F.struct((-z.cast("double")).alias("neg"), i.alias("i")))), 1, k)
    filler = F.array_repeat(F.struct((-F.try_element_at(logits, F.lit(1)).cast("double")).alias("neg"), F.lit(0).alias("i")), F.lit(k))
    return F.slice(F.concat(ranked, filler), 1, k)


def reduced(logits: Column, labels: Sequence[str]) -> dict[str, Column]:
    """Columns of a results row but for model, hash and time: codes and float probabilities of the TOP classes."""
    names = F.array(*(F.lit(x) for x in labels))
    best, whole, most = top(logits), denominator(logits), F.array_max(logits).cast("double")
    code = lambda k: F.element_at(names, F.element_at(best, k)["i"] + 1)
    prob = lambda k: (F.exp(-F.element_at(best, k)["neg"] - most) / whole).cast("float")
    out = {"classification": code(1), "probability": prob(1), "logit_argmax": F.array_max(logits).cast("float")}
    for k in range(2, TOP + 1):
        out |= {f"top{k}_code": code(k), f"top{k}_prob": prob(k)}
    return out
