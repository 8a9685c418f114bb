"""Document fingerprints by SpotSigs.

At every common word of a text (an anchor) the chain of the CHAIN content words that follow makes a signature; a text's
fingerprint is its set of signatures. Sets are compared by Jaccard: candidates are partitioned by set length, so that
sets of sufficient likeness lie in the same or the next partition, and share one of their rarest signatures.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import attach, with_row, written
from taxospark.llm.components import components, grouped

CHAIN = 3
LIKENESS = 0.8
WORD = re.compile(r"[^\W_]+")
#: Common words of English, German, French and Spanish; the anchors unless others are given.
ANCHORS = frozenset(
    """a an the of and to in is it that this was are be by as at for from on or with not have has had but they you he she his her we i
    der die das und im in zu den von mit ein eine ist des sich auf für nicht als auch an dem werden aus er sie es
    le la les de des du un une et en est que qui dans pour pas au aux sur par plus il elle ce ne se avec sont
    el los las una y del por con para como su al lo más pero sus no si o este entre cuando""".split()
)
#: Documents in one bucket of neighbours, and buckets at most: beyond that buckets hold more.
NEIGHBOURS, BUCKETS = 500, 100_000
LOWEST, LAST = -(2**63), 2**63 - 1
#: Texts whose signatures a worker holds at once.
STRETCH = 256


def signatures(text: str | None, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> frozenset[int]:
    """The 64-bit signatures of a text. One without a full chain has a single signature, of all its words or, without words, of all that isn't white space; one with nothing has none."""
    words = WORD.findall((text or "").lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in anchors:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    digest = xxhash.xxh3_64_intdigest
    found = {digest(" ".join((w, *content[k : k + chain]))) for w, k in spots if k <= last}
    if not found and (rest := words or (text or "").split()):
        found = {digest("\n".join(rest))}
    return frozenset(found)


def digest_of(sigs: frozenset[int]) -> str:
    """A set's number of signatures and a hash of them all, in hex."""
    data = np.sort(np.fromiter(sigs, np.uint64, len(sigs))).tobytes()
    return f"{len(sigs):08x}{hashlib.blake2b(data, digest_size=12).hexdigest()}"


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard; two empty sets are alike."""
    if not a or not b:
        return float(len(a) == len(b))
    if a is b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def with_next(docs: DataFrame, rows: int = NEIGHBOURS) -> DataFrame:
    """(bucket, tail, doc_id, text), in partitions that hold whole buckets, sorted: each document stands before the next one by doc_id.

    Passes over the ids alone cut them into buckets of about `rows` documents. An id with more rows than that has buckets
    of its own, by a hash of its rows' places, which is also the order of equal ids. A document goes to its bucket, and
    the first row of each bucket also to the end of the bucket before (tail = 1); the first of all follows the last of
    all. So texts are shuffled once, and no bucket grows with the input or with the rows of one id.
    """
    spark = docs.sparkSession
    placed = with_row(docs, "row", ["doc_id", "text"])
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key")
    keyed = placed.select(key, F.xxhash64("row").alias("turn"), "row", F.col("doc_id").cast("long"), "text")
    keys = keyed.select("key")
    total = keys.count()
    n = min(BUCKETS, max(1, math.ceil(total / rows)))
    each = max(rows, math.ceil(total / n))
    cuts = keys.approxQuantile("key", [i / n for i in range(1, n)], min(0.01, 0.25 / n)) if n > 1 else []
    often = [c for c, times in Counter(cuts).items() if times > 1]
    hot: dict[int, int] = {}
    if often:
        asked = spark.createDataFrame([(c,) for c in often], "near double")
        counts = keys.join(F.broadcast(asked), F.col("key").cast("double") == F.col("near")).groupBy("key").agg(F.count("*").alias("n"))
        # at most as many such ids as buckets
        hot = {r["key"]: math.ceil(r["n"] / each) for r in counts.filter(F.col("n") > each).collect()}
    # stretches of ids, each from its first one on; a hot id is a stretch of as many buckets as it needs
    starts = np.array(sorted({LOWEST, *(min(int(c), LAST) for c in cuts), *hot, *(k + 1 for k in hot if k < LAST)}), np.int64)
    widths = np.array([hot.get(int(k), 1) for k in starts], np.int64)
    first_bucket = np.cumsum(widths) - widths

    @F.pandas_udf("long")
    def bucket(key: pd.Series, turn: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, key.to_numpy(), "right") - 1
        share = (turn.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series(first_bucket[at] + np.minimum((share * widths[at]).astype(np.int64), widths[at] - 1))

    dealt = keyed.withColumn("bucket", bucket("key", "turn"))
    head = F.min(F.struct("key", "turn", "row")).alias("head")
    first = dealt.select("key", "turn", "row", "bucket").groupBy("bucket").agg(head).select("bucket", "head.row").orderBy("bucket").toArrow()
    before = np.roll(first["bucket"].to_numpy(), 1)  # of each bucket, one row: the bucket before
    heads = spark.createDataFrame(pd.DataFrame({"row": first["row"].to_numpy(), "before": before}), "row long, before long")
    sent = dealt.join(F.broadcast(heads), "row", "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))))
    twice = sent.select("key", "turn", "row", "doc_id", "text", F.inline(places).alias("at", "tail"))
    parts = max(1, int(widths.sum()))
    return twice.repartition(parts, "at").sortWithinPartitions("at", "tail", "key", "turn", "row").select(F.col("at").alias("bucket"), "tail", "doc_id", "text")


def fingerprint(docs: DataFrame, rows: int = NEIGHBOURS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many from the start of the
    next document, or all of it. Null texts count as empty. A null doc_id comes first in the order, and equal ids are
    ordered by a hash of their rows' places. A single document is its own next. Columns but doc_id and text are not read. An empty table gives
    no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None  # bucket, doc_id, text and signatures of the document before
        for b in batches:
            rows: list[tuple] = []
            for at, tail, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                sigs = last[3] if last and last[2] == text else signatures(text)
                if last and last[0] == at:
                    _, before, old, own = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    changed = own if edited == old else signatures(edited)
                    rows.append((before, len(old), hashlib.sha256(edited.encode()).hexdigest(), digest_of(own), digest_of(changed), likeness(own, changed), likeness(own, sigs)))
                last = None if tail else (at, doc, text, sigs)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return with_next(docs, rows).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (doc_id, text) those of (doc_id, fingerprint, sigs), STRETCH texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, STRETCH):
            part = b.slice(at, STRETCH)
            digests, sigs = [], []
            for text in part.column(1):
                found = signatures(text.as_py())
                digests.append(digest_of(found))
                sigs.append(np.sort(np.fromiter(found, np.uint64, len(found))).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.string()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "fingerprint", "sigs"])


def signature_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, sigs): the sorted signatures of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(signed, "doc_id long, fingerprint string, sigs array<long>")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) whose whole sets(node, sigs) have a Jaccard of `least` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("sigs").alias("sigs_a"))
    two = sets.select(F.col("node").alias("b"), F.col("sigs").alias("sigs_b"))
    both = F.size(F.array_intersect("sigs_a", "sigs_b"))
    return pairs.distinct().join(one, "a").join(two, "b").filter(both >= least * (F.size("sigs_a") + F.size("sigs_b") - both) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """One row per document: doc_id, class_id, the smallest doc_id reachable over pairs of likeness `least` or more.

    Equal sets are compared once. Sets of likeness t have lengths within a factor t, so partitions whose bounds grow by
    1 / t hold each pair in one or in neighbours. Two such sets of n signatures share one of the n - ceil(t * n) + 1
    rarest of each, by corpus frequency, so only those are looked up; pairs are then verified on the whole sets. Texts
    without signatures form one class. A null doc_id has its class's id but is never a class id where another is there.
    """
    rows = written(signature_sets(docs), "spotsigs")
    total = rows.count()
    sets = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("sigs").alias("sigs")), "spotsigs-sets")
    each = sets.filter("node is not null").select("node", "n", F.size("sigs").alias("size"), F.explode("sigs").alias("sig"))
    # written, as are hubs, so that the rows of a hot signature can be split
    common = written(each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"), "spotsigs-common")
    ranked = each.join(common, "sig").groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    # signatures in one set only are the rarest and can't be shared; they use up the front of the prefix
    prefix = F.expr(f"greatest(0, size - cast(ceil({least} * size - 1e-9) as int) + 1 - (size - size(by_df)))")
    level = F.floor(F.log(1 / least, F.col("size")) + 1e-9).cast("int")
    rare = written(ranked.select("node", "n", "size", level.alias("level"), F.slice("by_df.sig", F.lit(1), prefix).alias("rare")), "spotsigs-rare")
    # a set is first compared, for each rare signature, with the one of those sharing it that most documents have, and after
    # that only with sets not yet joined to it: the classes are the same, without all pairs of a family of near copies
    members = rare.select("node", "n", "rare", F.explode(F.array("level", F.col("level") + 1)).alias("level")).select("node", "n", "level", F.explode("rare").alias("sig"))
    hubs = members.groupBy("level", "sig").agg(F.min(F.struct(-F.col("n"), "node")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = written(hubs.select("level", "sig", F.col("hub.node").alias("a")), "spotsigs-hubs")
    first = written(alike(members.join(hubs, ["level", "sig"]).filter("a != node").select("a", F.col("node").alias("b")), sets, least), "spotsigs-stars")
    probe = grouped(rare, first).select("node", "size", "level", "group", F.explode("rare").alias("sig"))
    left = probe.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("group").alias("group_a"), F.explode(F.array("level", F.col("level") + 1)).alias("level"), "sig", F.col("level").alias("own"))
    right = probe.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("group").alias("group_b"), "level", "sig")
    fits = (F.col("size_a") >= least * F.col("size_b") - 1e-9) & (F.col("size_b") >= least * F.col("size_a") - 1e-9)
    once = (F.col("own") < F.col("level")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["level", "sig"]).filter(fits & once & (F.col("group_a") != F.col("group_b"))).select("a", "b")
    links = first.unionByName(alike(pairs, sets, least))
    found = sets.join(components(links), "node", "left").select("fingerprint", "n", F.coalesce("label", "node").alias("class_id"))
    return attach(rows.select("doc_id", "fingerprint"), written(found, "spotsigs-classes"), "fingerprint", "n", total).select("doc_id", "class_id")
