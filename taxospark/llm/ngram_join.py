"""N-gram Jaccard self-join by grouped prefixes.

A document is the set of its word shingles. All shingles have one order: those that many documents have come last, others
by their hash. Two sets with a Jaccard similarity of PERCENT or more have a shingle in common among the first
n - ceil(PERCENT n / 100) + 1 of each, their prefixes. Equal sets are one node; nodes with equal size and prefix are one
group, so that prefixes are indexed and joined once a group. Pairs of groups that share a shingle are filtered by their
sizes, by the places where they share it and by signatures; what is left is expanded into members, and these are compared
as whole sets. A signature has BITS parities of the shingles' hashes; two sets differ in at least as many shingles as their
signatures differ in bits, and a group's members in at least as many as its head's signature tells, less their distance
from it.

In a dense family of near copies nearly all pairs match. So each node is first compared with the head of its group, and
with the head of the group, of all that share a shingle, that most documents have: stars, no more pairs than places. Pairs
that stars have joined are passed over after that; the components are the same.

How often a shingle stands in prefixes decides its level in the order. Levels are kept for the SLOTS / 4 most frequent
shingles at most, in a table of fixed size by hash, which tasks hold; any table gives right results, since shingles in one
slot share a level and the order stays one for all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import attach, with_row, written
from taxospark.llm.components import components

WORDS, PERCENT = 3, 90
#: Slots of the table of levels, and prefixes that a shingle stands in at least to have one.
SLOTS, FREQUENT = 1 << 22, 8
#: Slots of the filter of shingles that several groups share; bits of a signature.
SHARED, BITS = 1 << 27, 256
#: Rows whose texts are looked up by a broadcast of their numbers at most; more are joined by a shuffle.
LOOKED_UP = 1 << 20
#: Members that are compared with one text in a row of tasks' input, and words whose hashes a task remembers.
CHUNK, MEMORY = 256, 1 << 16


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences of words from those of all but the last word and the last word's."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + word
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct runs of `words` words, ascending; of fewer words, the one of their sequence; without words, none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out, h[i : len(h) - k + 1 + i])
    return np.unique(out)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def prefix(hashes: np.ndarray, levels: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """The first hashes of a set in the order of (level, hash). hashes: ascending."""
    p = prefix_size(len(hashes), percent)
    if levels is None:
        return hashes[:p]
    return hashes[np.argsort(levels[slot(hashes, len(levels))], kind="stable")[:p]]


SIGNATURE = [f"s{i}" for i in range(BITS // 64)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """BITS parities: of how many of the hashes fall to each bit."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(a: str, b: str) -> str:
    """SQL: in how many bits the signatures of two rows differ, whose columns end in a and b."""
    return "(" + " + ".join(f"bit_count({s}{a} ^ {s}{b})" for s in SIGNATURE) + ")"


def alike(differ: str, n: str, percent: int) -> str:
    """SQL: whether sets of n shingles together that differ in so many can be similar enough."""
    return f"(100 + {percent}) * ({differ}) <= (100 - {percent}) * ({n})"


def levels(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> np.ndarray:
    """Levels by slot: 0, or the number of bits of how many prefixes in the order of hashes have the slot's most frequent shingle.

    A shingle that many documents have stands in the prefix of its share of them. Of `total` places in prefixes fewer than
    SLOTS / 4 shingles have 4 / SLOTS of the places, so the table that comes to the driver is bounded at any size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = [prefix(shingles(t.as_py(), known, words), None, percent) for t in b.column(0)]
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            del found
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    counts = written(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "ngram-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.filter(F.col("n") >= max(FREQUENT, 4 * total // SLOTS))
    top = often.groupBy(F.expr(f"shingle & {SLOTS - 1}L").alias("slot")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[top["slot"].to_numpy()] = np.floor(np.log2(top["n"].to_numpy().astype(float))).astype(np.uint8)
    return out


def sets(docs: DataFrame, row: str, table: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n (shingles), digest of the set, prefix_digest (of size and prefix), prefix (array of long) and signature of every text."""
    told = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = WordHashes(), told.value
        for b in batches:
            n, digest, prefix_digest, prefixes = [], [], [], []
            signatures = np.zeros((b.num_rows, len(SIGNATURE)), np.int64)
            for i, t in enumerate(b.column(2)):
                found = shingles(t.as_py(), known, words)
                signatures[i] = signature(found)
                first = prefix(found, order, percent)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                prefix_digest.append(hashlib.blake2b(first.tobytes() + len(found).to_bytes(8, "big"), digest_size=16).digest())
                prefixes.append(first.view(np.int64))
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix_digest, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), *map(pa.array, signatures.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", row, "n", "digest", "prefix_digest", "prefix", *SIGNATURE])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), row, "text").mapInArrow(run, f"doc_id long, `{row}` long, n long, digest binary, prefix_digest binary, prefix array<long>, {', '.join(f'{c} long' for c in SIGNATURE)}")


def shared_filter(places: DataFrame) -> np.ndarray:
    """Bits by slot, set where a shingle of places(shingle, ...) stands twice or more; SHARED / 64 numbers come to the driver."""
    several = places.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select(F.expr(f"shingle & {SHARED - 1}L").alias("slot"))
    held = several.groupBy((F.col("slot") / 64).cast("int").alias("block")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits")).toArrow()
    out = np.zeros(SHARED // 64, np.uint64)
    out[held["block"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return out


def shared_places(groups: DataFrame, bits: np.ndarray) -> DataFrame:
    """(shingle, at, grp, n, docs) of groups(grp, n, docs, prefix) for the shingles that pass the filter; at: the place in the prefix."""
    told = groups.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        for b in batches:
            prefixes = b.column(3)
            hashes = prefixes.flatten().to_numpy()
            sizes = prefixes.value_lengths().fill_null(0).to_numpy()
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            s = slot(hashes.view(np.uint64), 64 * len(bits))
            keep = np.flatnonzero((bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1))
            of = pa.array(np.repeat(np.arange(b.num_rows), sizes)[keep])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(at[keep].astype(np.int32)), *(b.column(i).take(of) for i in range(3))], ["shingle", "at", "grp", "n", "docs"])

    return groups.select("grp", "n", "docs", "prefix").mapInArrow(run, "shingle long, at int, grp long, n long, docs long")


def may_link(n_a: str, at_a: str, n_b: str, at_b: str, percent: int) -> str:
    """SQL: whether sets of these sizes, whose first common shingle stands at these places, can be similar enough."""
    most = f"1 + least({n_a} - {at_a} - 1, {n_b} - {at_b} - 1)"
    return f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and (100 + {percent}) * ({most}) >= {percent} * ({n_a} + {n_b})"


def verified(pairs: DataFrame, docs: DataFrame, row: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts' sets are similar enough. pairs: written; docs has the texts by row = node.

    A text a and the texts it is compared with, CHUNK or so of them at a time, meet in one task and stream through it.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = docs.select(F.col(row).alias("node"), "text")
    wanted = F.broadcast(wanted) if 2 * pairs.count() <= LOOKED_UP else wanted.hint("merge")
    texts = written(own.join(wanted, "node", "left_semi"), "ngram-texts")
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / CHUNK)).alias("chunk")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    dealt = pairs.join(sizes, "a").select("a", "b", chunk)
    second = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "text")
    heads = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    met = second.unionByName(heads).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = shingles(text.as_py(), known, words)
                if b is None:
                    head = own
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both and 100 * both >= percent * (len(head) + len(own) - both):
                    found.append((a, b))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("a", "b", "text").mapInArrow(run, "a long, b long")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with label, the smallest node reachable over links."""
    return nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))


def cells(labels: DataFrame) -> DataFrame:
    """(grp, label, size, n, spread, signature) of labels(node, grp, n, label, signature), written, by cell: a group's members of one label.

    The signature is that of the cell's head; spread tells in how many bits a member's differs from it at most.
    """
    head = F.min(F.struct("node", *SIGNATURE)).alias("head")
    found = labels.groupBy("grp", "label").agg(F.count("*").alias("size"), F.first("n").alias("n"), head)
    found = written(found.select("grp", "label", "size", "n", *(F.col(f"head.{c}").alias(c) for c in SIGNATURE)), "ngram-cell-heads")
    wide = found.filter("size > 1").select("grp", "label", *(F.col(c).alias(f"{c}_head") for c in SIGNATURE))
    spreads = labels.join(wide, ["grp", "label"]).groupBy("grp", "label").agg(F.max(F.expr(differing("", "_head"))).alias("spread"))
    return written(found.join(spreads, ["grp", "label"], "left").withColumn("spread", F.coalesce("spread", F.lit(0))), "ngram-cell-spreads")


def cell_pairs(pairs: DataFrame, cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs(grp_a, grp_b) of groups the pairs of cells that may have similar members, by their heads' signatures.

    The larger cell comes first: grp_a, label_a, grp_b, label_b, and the smaller one's n_head, spread_head and signature (.._head).
    """
    a, b = (cells.toDF(*(f"{c}_{x}" for c in cells.columns)) for x in "ab")
    near = alike(differing("_a", "_b") + " - spread_a - spread_b", "n_a + n_b", percent)
    met = pairs.join(a, "grp_a").join(b, "grp_b").filter(f"label_a != label_b and (grp_a != grp_b or label_a < label_b) and {near}")
    larger = F.expr("size_a >= size_b")
    pick = lambda c, x, y: F.when(larger, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    heads = [pick(c, "b", "a").alias(f"{c}_head") for c in ("n", "spread", *SIGNATURE)]
    return met.select(*(pick(c, "a", "b").alias(f"{c}_a") for c in ("grp", "label")), *(pick(c, "b", "a").alias(f"{c}_b") for c in ("grp", "label")), *heads)


def node_links(nodes: DataFrame, groups: DataFrame, docs: DataFrame, row: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between nodes that have the components of all pairs with similar sets: stars, then all pairs that stars haven't joined.

    nodes: (node, grp, n, signature), groups: (grp, n, docs, spread, signature, prefix), both written; docs has the texts by
    row = node. A group's number is its head's.
    """
    places = groups.select(F.explode("prefix").alias("shingle"))
    shared = written(shared_places(groups, shared_filter(places)), "ngram-places")
    # the group of most documents among those that share a shingle
    hub = F.min(F.struct(-F.col("docs"), "grp", "n", "at")).alias("hub")
    hubs = written(shared.groupBy("shingle").agg(hub, F.count("*").alias("size")).filter("size > 1").select("shingle", "hub.grp", "hub.n", "hub.at").toDF("shingle", "grp_a", "n_a", "at_a"), "ngram-hubs")
    met = shared.join(hubs, "shingle").filter("grp != grp_a").filter(may_link("n_a", "at_a", "n", "at", percent)).select("grp_a", "grp").distinct()
    a, b = (nodes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "grp", "n", *SIGNATURE))) for x in "ab")
    similar = alike(differing("_a", "_b"), "n_a + n_b", percent)
    across = met.join(a.filter("node_a = grp_a"), "grp_a").join(b.withColumnRenamed("grp_b", "grp"), "grp")
    inside = a.filter("node_a = grp_a").join(b.filter("node_b != grp_b"), F.col("grp_a") == F.col("grp_b"))
    tried = written(across.filter(similar).select("node_a", "node_b").unionByName(inside.filter(similar).select("node_a", "node_b")).toDF("a", "b"), "ngram-star-pairs")
    stars = written(verified(tried, docs, row, words, percent), "ngram-stars")

    labels = written(labelled(nodes, stars), "ngram-labels")
    state = labels.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    state = written(state.join(groups.select("grp", "spread", *SIGNATURE), "grp"), "ngram-state")
    unsettled = written(shared.join(hubs.select("shingle"), "shingle", "left_semi").drop("docs").join(state, "grp"), "ngram-unsettled")
    left, right = (unsettled.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("grp", "n", "at", "low", "high", "spread", *SIGNATURE))) for x in "ab")
    apart = "grp_a < grp_b and not (low_a = high_a and low_b = high_b and low_a = low_b)"
    near = alike(differing("_a", "_b") + " - spread_a - spread_b", "n_a + n_b", percent)
    on = (left["shingle"] == right["shingle"]) & F.expr(f"{apart} and {may_link('n_a', 'at_a', 'n_b', 'at_b', percent)} and {near}")
    pairs = left.join(right, on).select("grp_a", "grp_b").distinct()
    own = state.filter("low != high").select(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b"))
    pairs = written(pairs.unionByName(own), "ngram-group-pairs")
    # cells are paired before their members, so that what a star has joined isn't expanded, and a cell's members are held
    # against the head of a smaller one before its members
    both = pairs.select(F.explode(F.array("grp_a", "grp_b")).alias("grp")).distinct()
    open_ = written(labels.select("node", "grp", "n", "label", *SIGNATURE).join(both, "grp", "left_semi"), "ngram-open")
    apart = written(cell_pairs(pairs, cells(open_), percent), "ngram-cells")
    a, b = (open_.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "grp", "n", "label", *SIGNATURE))) for x in "ab")
    held = apart.join(a, ["grp_a", "label_a"]).filter(alike(differing("_a", "_head") + " - spread_head", "n_a + n_head", percent))
    both = held.join(b, ["grp_b", "label_b"]).filter(similar)
    ordered = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
    rest = both.select(*ordered).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = written(rest, "ngram-rest-pairs")
    return stars.unionByName(written(verified(rest, docs, row, words, percent), "ngram-rest"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct), component_id (smallest doc_id reachable over links, itself included), copies (rows with the same set).

    Documents link when 100 * shared shingles >= percent * shingles of either. A text of fewer than `words` words has one
    shingle, all of it; one without words, or null, has none and links with nothing, not even its like. Rows that repeat a
    doc_id give a row each. A null doc_id takes part like any other, but is a component's id only where that has no other.
    Columns but doc_id and text are not read, so they may have any name. An empty table gives no rows. Shingles are told
    apart by 64-bit hashes, equal sets by 128-bit ones.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    row = "_ngram_row"
    source = with_row(docs, row, ["doc_id", "text"])
    found = written(sets(source, row, levels(docs, words, percent), words, percent), "ngram-sets")
    with_words = found.filter("n > 0")
    firsts = [F.first(c).alias(c) for c in ("n", "prefix_digest", *SIGNATURE)]
    classes = written(with_words.groupBy("digest").agg(F.min(row).alias("node"), F.count("*").alias("docs"), F.min("doc_id").alias("least"), *firsts), "ngram-classes")
    head = F.min(F.struct(-F.col("docs"), "node", *SIGNATURE)).alias("head")
    groups = classes.groupBy("prefix_digest").agg(head, F.first("n").alias("n"), F.sum("docs").alias("docs"))
    groups = written(groups.select("prefix_digest", F.col("head.node").alias("grp"), "n", "docs", *(F.col(f"head.{c}").alias(f"{c}_head") for c in SIGNATURE)), "ngram-heads")
    members = classes.drop("docs").join(groups.drop("n", "docs"), "prefix_digest").withColumn("off", F.expr(differing("", "_head")))
    nodes = written(members.select("node", "grp", "n", "off", *SIGNATURE), "ngram-nodes")
    spreads = nodes.groupBy("grp").agg(F.max("off").alias("spread"))
    prefixes = with_words.select(F.col(row).alias("grp"), "prefix", *SIGNATURE)
    whole = written(groups.select("grp", "n", "docs").join(spreads, "grp").join(prefixes, "grp"), "ngram-groups")
    links = written(node_links(nodes.drop("off"), whole, source, row, words, percent), "ngram-links")
    labels = classes.select("digest", "node", "docs", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("label", "node"))
    labels = written(labels.select("digest", "docs", "least", "root"), "ngram-roots")
    firsts = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(labels.join(firsts, "root").select("digest", F.col("docs").alias("copies"), "component_id"), "ngram-components")
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    total = found.count()
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return attach(rows.filter("n_shingles > 0"), known, "digest", "copies", total).select("doc_id", "n_shingles", "component_id", "copies").unionByName(none)
