"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two 32-bit segments. Two fingerprints at most 3 bits apart agree in one segment but for one
bit, so each looks up, in the tables of both segments, the Hamming ball of radius 1 about its own segment; a match is
verified over all 64 bits. Where the segments differ in one bit, one of the two has it set, so it is enough that each
clears its set bits: 17 look-ups a segment on average instead of 33.

In a dense ball of near copies nearly all pairs match. So every table entry is first compared with the fingerprint of its
own place that most rows have (a star, no more links than entries), and look-ups then pass over what the stars have joined
already: the components are the same, without all pairs of a ball about a common text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import attach, with_row, written
from taxospark.llm.components import components, grouped

SEED = 42
WORDS = 3
BITS = 3


def simhash(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of a text as an unsigned integer: majority bits of XXH64 over its word shingles."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate((len(p) + 1 for p in parts)))
    starts = [0, *ends]
    shingles = [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :])]
    hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    votes = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, row: str | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and the column `row` if one is named. Null and empty texts have fingerprint zero."""
    own = [F.col("doc_id").cast("long"), *([F.col(row).cast("long")] if row else [])]
    names = ["doc_id", *([row] if row else []), "fp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), words) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names)

    return docs.select("text", *own).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def segments(nodes: DataFrame) -> DataFrame:
    """nodes with `segment` and `value`, a row for each of the two tables."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return nodes.select("*", F.posexplode(F.array(low, high)).alias("segment", "value"))


def near(x: str, y: str, bits: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= bits


def stars(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of nodes(node, fp, n) at most `bits` bits apart, where a has the largest n of those that share a segment with b."""
    cut = segments(nodes.select("node", "fp", "n"))
    hub = F.min(F.struct(-F.col("n"), "node", "fp")).alias("hub")
    hubs = cut.groupBy("segment", "value").agg(hub, F.count("*").alias("size")).filter("size > 1")
    # written, so that the rows of a hot place can be split
    hubs = written(hubs.select("segment", "value", F.col("hub.node").alias("a"), F.col("hub.fp").alias("fp_a")), "simhash-hubs")
    met = cut.join(hubs, ["segment", "value"])
    return met.filter((F.col("a") != F.col("node")) & near("fp_a", "fp", bits)).select("a", F.col("node").alias("b"))


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most `bits` of 64 bits, but those of one group.

    nodes: one row (node, fp, group) for each distinct fingerprint; without a column group, all pairs are returned. bits
    is 3 at most: with two segments, a radius of 1 in a segment finds all of these pairs.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius 1 find pairs up to 3 bits apart")
    cut = segments(nodes if "group" in nodes.columns else nodes.withColumn("group", F.col("node")))
    cleared = F.expr("transform(filter(sequence(0L, 31L), i -> shiftright(value, int(i)) & 1 = 1), i -> value - shiftleft(1L, int(i)))")
    own = [F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("group").alias("group_a"), "segment"]
    probes = cut.select(*own, "value", F.lit(True).alias("same")).unionByName(cut.select(*own, F.explode(cleared).alias("value"), F.lit(False).alias("same")))
    there = cut.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("group").alias("group_b"), "segment", "value")
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    apart = F.col("group_a") != F.col("group_b")
    on = (probes["segment"] == there["segment"]) & (probes["value"] == there["value"]) & apart & near("fp_a", "fp_b", bits) & once
    return probes.join(there, on).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), kept.

    Texts with no word have fingerprint zero and link like any other. Rows that repeat a doc_id give a row each. A null
    doc_id takes part like any other but is a component's id only where that has no other. Of each component one row is
    kept, with the smallest doc_id and, where that is repeated, the smallest place. `row` names a column of longs, without
    nulls, that tells rows apart; it is returned too. Columns but these, doc_id and text are not read, so they may have
    any name. An empty table gives no rows.
    """
    number = row or "row"
    rows = written(fingerprints(docs, words, row), "simhash-fingerprints")
    if not row:
        rows = with_row(rows, number)
    total = rows.count()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(number).alias("row")))
    nodes = written(rows.groupBy("fp").agg(best.alias("best"), F.count("*").alias("n")), "simhash-nodes")
    alone = nodes.select(F.col("fp").alias("node"), "fp", "n")
    first = written(stars(alone, bits), "simhash-stars")
    rest = links(written(grouped(alone.drop("n"), first), "simhash-starred"), bits)
    found = components(first.unionByName(rest)).withColumnRenamed("node", "fp")
    labelled = written(nodes.join(found, "fp", "left").select("fp", "n", "best", F.coalesce("label", "fp").alias("root")), "simhash-labels")
    firsts = labelled.groupBy("root").agg(F.min("best").alias("first"))
    groups = labelled.join(firsts, "root").select("fp", "n", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))
    return attach(rows, written(groups, "simhash-groups"), "fp", "n", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col(number) == F.col("keep_row")).alias("kept"), *([row] if row else [])
    )
