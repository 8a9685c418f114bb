"""Phrase collocations from depth-truncated suffix trees, built by vertical partitioning.

Every word of a corpus starts a suffix, cut where its piece of text ends and after DEPTH words. The suffixes of one prefix
make up one subtree. Prefixes are single words; one that starts more suffixes than a group may hold (BUDGET) is extended
by the next word, and by the one after that if need be. Prefixes are placed by their hash in CELLS cells, and adjacent cells
are put together into groups as large as the budget allows. A group's suffixes meet in one task, which sorts them, so that
each node of a subtree is a run of rows: its leaves' total is how often its phrase occurs.

Tasks send suffixes as counts of distinct ones, packed in blocks of words and places, a block for each group and part of
their input, so that what is shuffled is some bytes a suffix. A word that is rarer than a candidate may be ends a suffix as
the end of its piece does, by a filter of FILTER bits that lets some rare words pass and stops no other; counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxospark.llm.common import written

DEPTH = 3
#: Candidates' least occurrences, the share of them (in percent) that drops a phrase inside a longer one, and phrases kept for each language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Suffixes of a group (or the CELLS-th part of all, if that is more), cells by the first 16 bits of a prefix's hash, bits of the filter of frequent words.
BUDGET, CELLS, FILTER = 1 << 20, 1 << 16, 1 << 24
#: Words of a part of the input, about, whose suffixes are counted before they are sent.
PART = 1 << 21
SCORE = 1_000_000
#: What separates pieces becomes a byte that UTF-8 never has, the other white space a space.
MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\xff" * 10 + b" ")


def words_of(text: str) -> list[bytes]:
    """The lower-cased words of a text, with the byte 0xFF as a word of its own between pieces and at the end."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(MARKS)
    return (data + b"\xff").replace(b"\xff", b" \xff ").split()


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of a phrase from those of all its words but the last and of the last; of one word, the word's own. Numbers are never 0."""
    with np.errstate(over="ignore"):
        x = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.maximum(x ^ (x >> np.uint64(29)), np.uint64(1))


def word_number(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\xff" + word) or 1


def cell_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(48)).astype(np.int64)


class Part:
    """Words of consecutive texts as places in a vocabulary: 0 stands between pieces. Words of different languages are different."""

    def __init__(self) -> None:
        self.size, self.texts = 0, []
        self.places: dict[str, defaultdict] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]

    def add(self, lang: str, text: str) -> None:
        if lang not in self.places:
            fresh = defaultdict(lambda: self._place(lang))
            fresh[b"\xff"] = 0
            self.places[lang] = fresh
        known = self.places[lang]
        found = words_of(text)
        before = len(self.words)
        places = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        if len(self.words) > before:  # new words got their places in the order in which they came
            named = {p: w for w, p in zip(found, places.tolist()) if p >= before}
            for p in range(before, len(self.words)):
                self.words[p] = (lang, named[p])
        self.texts.append(places)
        self.size += len(found)

    def _place(self, lang: str) -> int:
        self.words.append((lang, b""))
        return len(self.words) - 1

    def numbers(self) -> np.ndarray:
        return np.array([0, *(word_number(lang, w) for lang, w in self.words[1:])], np.uint64)

    def all(self) -> np.ndarray:
        return np.concatenate([*self.texts, np.zeros(DEPTH, np.int32)])


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    """The texts (lang, text) of a task in parts of about PART words; a longer text is a part of its own."""
    part = Part()
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            part.add(lang.as_py(), text.as_py())
            if part.size >= PART:
                yield part
                part = Part()
    if part.size:
        yield part


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, number, n) of all words of texts(lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n = np.bincount(part.all(), minlength=len(part.words))[1:]
            lang, word = zip(*part.words[1:]) if len(part.words) > 1 else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(part.numbers()[1:].view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "number", "n"])

    counted = texts.mapInArrow(run, "lang string, word binary, number long, n long")
    return counted.groupBy("lang", "word").agg(F.first("number").alias("number"), F.sum("n").alias("n"))


def prefixes(part: Part, heavy: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """All suffixes of a part as three columns of places, their prefix's number and its words; heavy: sorted numbers of words, twice: of phrases of two.

    Words that are heavy are extended by the next one, and phrases of two that are by the third.
    """
    places, numbers = part.all(), part.numbers()
    a, b, c = places[:-2], places[1:-1], places[2:]
    c = np.where(b == 0, 0, c)
    begin = a > 0
    a, b, c = a[begin], b[begin], c[begin]
    prefix, words = numbers[a], np.ones(len(a), np.int8)
    for longer, last, k in ((heavy, b, 1), (twice, c, 2)):
        at = np.flatnonzero((words == k) & (last > 0))
        at = at[np.isin(prefix[at], longer)]
        prefix[at] = extended(prefix[at], numbers[last[at]])
        words[at] += 1
    return a, b, c, prefix, words


def longer_counts(texts: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(number, n, first) of all phrases of two words whose first, by its number, is heavy."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            a, _, _, prefix, words = prefixes(part, heavy, np.zeros(0, np.uint64))
            prefix, at, n = np.unique(prefix[words == 2], return_index=True, return_counts=True)
            first = part.numbers()[a[words == 2][at]]
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(first.view(np.int64)), pa.array(n.astype(np.int64))], ["number", "first", "n"])

    return texts.mapInArrow(run, "number long, first long, n long").groupBy("number", "first").agg(F.sum("n").alias("n"))


def cell_sizes(numbered: DataFrame) -> np.ndarray:
    """Suffixes of the prefixes (number, n) in each cell; CELLS rows at most come to the driver."""
    found = numbered.groupBy(F.shiftrightunsigned("number", 48).cast("int").alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    sizes = np.zeros(CELLS, np.int64)
    sizes[found["cell"].to_numpy()] = found["n"].to_numpy()
    return sizes


def grouped_cells(sizes: np.ndarray, budget: int) -> np.ndarray:
    """The group of each cell: adjacent cells as long as they hold `budget` suffixes at most; a cell that holds more is a group."""
    out, group, held = np.zeros(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > budget:
            group, held = group + 1, 0
        held += n
        out[i] = group
    return out


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """A bit for each of FILTER slots, set if a word with such a number is frequent; FILTER / 64 numbers come to the driver."""
    slot = F.expr(f"number & {FILTER - 1}L")
    held = frequent.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("block")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.uint64)
    out[held["block"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return out


def passes(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = numbers & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def packed(numbers: np.ndarray, suffixes: tuple[np.ndarray, ...], n: np.ndarray) -> list[bytes]:
    """Suffixes of a part that go to one group: the numbers of their words, three columns of places among these, counts."""
    used, at = np.unique(np.concatenate(suffixes), return_inverse=True)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    columns = at.reshape(3, -1).astype(kind)
    return [numbers[used].tobytes(), columns.tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()]


def sent(texts: DataFrame, bits: np.ndarray, heavy: np.ndarray, twice: np.ndarray, groups: np.ndarray) -> DataFrame:
    """(group, numbers, places, counts, more): the distinct suffixes of each part of the input, by group, packed."""
    spark = texts.sparkSession
    told = spark.sparkContext.broadcast((bits, heavy, twice, groups))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy, twice, groups = told.value
        for part in parts(batches):
            numbers = part.numbers()
            frequent = passes(numbers, bits)
            frequent[0] = False
            a, b, c, prefix, _ = prefixes(part, heavy, twice)
            keep = frequent[a]
            a, b, c, prefix = a[keep], b[keep], c[keep], prefix[keep]
            b = np.where(frequent[b], b, 0)
            c = np.where(frequent[c] & (b > 0), c, 0)
            # words in the order of their places, so that equal suffixes are neighbours
            order = np.lexsort((c, b, a))
            a, b, c, prefix = a[order], b[order], c[order], prefix[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0)])[: len(a)])
            n = np.diff(new, append=len(a))
            a, b, c, group = a[new], b[new], c[new], groups[cell_of(prefix[new])]
            by = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[by])) + 1
            rows = [(int(group[at[0]]), *packed(numbers, (a[at], b[at], c[at]), n[at])) for at in np.split(by, cuts) if len(at)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["group", "numbers", "places", "counts", "more"])

    return texts.mapInArrow(run, "group int, numbers binary, places binary, counts binary, more binary")


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a group: the numbers of its words, ascending (0 first), suffixes as places among these (n by 3), counts."""
    numbers = [np.frombuffer(x.as_py(), np.uint64) for x in rows["numbers"]]
    known = np.unique(np.concatenate([np.zeros(1, np.uint64), *numbers]))
    suffixes, counts = [], []
    for own, places, n, more in zip(numbers, rows["places"], rows["counts"], rows["more"]):
        size = len(n.as_py())
        at = np.frombuffer(places.as_py(), np.uint16 if len(own) < 1 << 16 else np.uint32).reshape(3, size)
        suffixes.append(np.searchsorted(known, own)[at].astype(np.int32))
        held = np.frombuffer(n.as_py(), np.uint8).astype(np.int64)
        held[held == 255] = np.frombuffer(more.as_py(), np.int64)
        counts.append(held)
    return known, np.concatenate(suffixes, axis=1), np.concatenate(counts)


NODES = "number long, size int, w1 long, w2 long, w3 long, head long, tail long, a long, l1 long, l2 long"


def subtrees(rows: pa.Table, heavy: dict[int, int], twice: dict[int, int], least: int) -> pa.Table:
    """The nodes of a group's subtrees that stand for phrases of two words or three and have `least` occurrences or more.

    A node's count is its leaves' total: the sum over the run of sorted suffixes below it. heavy and twice have the counts
    of prefixes that were extended, whose subtrees are in several groups.
    """
    numbers, (a, b, c), n = unpacked(rows)
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    total = np.concatenate([[0], np.cumsum(n)])
    ends, starts = [], []
    step = [np.diff(x, prepend=-1) != 0 for x in (a, b, c)]
    new = np.zeros(len(a), bool)
    for x in step:
        new = new | x
        starts.append(np.flatnonzero(new))
        ends.append(np.append(starts[-1][1:], len(a)))
    counts = [total[e] - total[s] for s, e in zip(starts, ends)]
    words = [numbers[x] for x in (a, b, c)]
    two = extended(words[0], words[1])
    out = []
    one = np.repeat(counts[0], ends[0] - starts[0])  # of each row's first word
    if heavy:
        known = np.array(sorted(heavy), np.uint64)
        at = np.minimum(np.searchsorted(known, words[0]), len(known) - 1)
        one = np.where(known[at] == words[0], np.array([heavy[int(k)] for k in known])[at], one)
    pair = np.repeat(counts[1], ends[1] - starts[1])  # of each row's first two words
    if twice:
        known = np.array(sorted(twice), np.uint64)
        at = np.minimum(np.searchsorted(known, two), len(known) - 1)
        pair = np.where(known[at] == two, np.array([twice[int(k)] for k in known])[at], pair)
    for size, last in ((2, b), (3, c)):
        at = starts[size - 1]
        f = counts[size - 1] if size == 3 else pair[at]
        keep = (last[at] > 0) & (f >= least)
        at, f = at[keep], f[keep]
        w1, w2, w3 = (x[at] for x in words)
        number = two[at] if size == 2 else extended(two[at], w3)
        tail = w2 if size == 2 else extended(w2, w3)
        head = w1 if size == 2 else two[at]
        third = np.zeros(len(at), np.uint64) if size == 2 else w3
        out.append([number, np.full(len(at), size, np.int32), w1, w2, third, head, tail, f, one[at], pair[at]])
    columns = [np.concatenate(x) for x in zip(*out)]
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns]
    return pa.table(arrays, [x.split()[0] for x in NODES.split(", ")])


def phrases(texts: DataFrame, counts: DataFrame, budget: int = BUDGET, least: int = LEAST) -> DataFrame:
    """The phrases of two words and three that occur `least` times or more in texts(lang, text), with NODES' columns.

    counts: of word_counts(texts), written. number, w1 to w3, head and tail (all words but the last, but the first) are
    numbers of phrases; a is how often the phrase occurs, l1 its first word, l2 its first two.
    """
    spark = texts.sparkSession
    frequent = counts.filter(F.col("n") >= least)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // CELLS))
    over = lambda df: {np.uint64(r[0] % 2**64).item(): r[1] for r in df.filter(F.col("n") > budget).select("number", "n").collect()}  # noqa: E731  fewer than total / budget <= CELLS
    heavy = over(counts)
    sizes = cell_sizes(counts.filter(F.col("n") <= budget))
    firsts, twice = np.array(sorted(heavy), np.uint64), {}
    if heavy:
        longer = written(longer_counts(texts, firsts), "phrase-prefixes")
        twice = over(longer)
        sizes = sizes + cell_sizes(longer.filter(F.col("n") <= budget))
    groups = grouped_cells(sizes, budget)
    blocks = sent(texts, frequent_filter(frequent), firsts, np.array(sorted(twice), np.uint64), groups)
    nodes = written(blocks.groupBy("group").applyInArrow(lambda rows: subtrees(rows, heavy, twice, least), NODES), "phrase-nodes")
    # an extended phrase of two words has a node in each of the groups that its subtree is in
    repeats = (F.col("size") == 2) & (F.col("a") > budget)
    return nodes.filter(~repeats).unionByName(nodes.filter(repeats).dropDuplicates(["number"]))


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCORE * a * a / (l * r)), exactly: in decimals of 38 digits, enough while a phrase occurs fewer than 10 ** 16 times."""
    whole = [x.cast("decimal(16,0)") for x in (a, l, r)]
    return F.call_function("div", whole[0] * whole[0] * F.lit(SCORE).cast("decimal(7,0)"), whole[1] * whole[2])


def collocations(docs: DataFrame, budget: int = BUDGET, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, and cut, the words of the first part.

    Texts (null: empty) are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and these into words at spaces
    and tabs. Candidates are phrases of two words or three that occur `least` times or more within pieces; the cut with
    the lowest score counts, of equal ones the first. A phrase inside a longer candidate that occurs at least `covered`
    percent as often is dropped. Ties in score and occurrences are ranked by the phrase's bytes. A null language is und; a
    language without candidates has no row, nor has an empty table. Repeated rows count as often as they stand there.
    Columns but lang and text are not read, so they may have any name. Words are told apart by 64-bit hashes in between.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(texts), "phrase-words")
    found = phrases(texts, counts, budget, least)
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("n") >= least)
    pairs, triples = found.filter("size = 2"), found.filter("size = 3")
    # the longer candidates about a pair, and how often the most frequent of them occurs
    about = triples.select(F.explode(F.array("head", "tail")).alias("number"), "a").groupBy("number").agg(F.max("a").alias("longest"))
    kept = pairs.join(about, "number", "left").filter(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(covered) * F.col("a"))).drop("longest")
    ends = pairs.select(F.col("number").alias("tail"), F.col("a").alias("r1"))
    whole = kept.withColumn("r1", F.lit(None).cast("long")).unionByName(triples.join(ends, "tail"))
    for i in (1, 2, 3):
        own = words.select(F.col("number").alias(f"w{i}"), *([F.col("lang")] if i == 1 else []), F.col("word").alias(f"word{i}"), F.col("n").alias(f"n{i}"))
        whole = whole.join(own, f"w{i}", "inner" if i < 3 else "left")
    first = F.when(F.col("size") == 2, score(F.col("a"), F.col("l1"), F.col("n2"))).otherwise(score(F.col("a"), F.col("l1"), F.col("r1")))
    second = F.when(F.col("size") == 3, score(F.col("a"), F.col("l2"), F.col("n3")))
    whole = whole.withColumns({"s1": first, "s2": second}).withColumn("cut", F.when(F.col("s2") < F.col("s1"), 2).otherwise(1))
    early = F.col("cut") == 1
    spaced = F.concat_ws(" ", *(F.decode(f"word{i}", "UTF-8") for i in (1, 2, 3)))
    scored = whole.select(
        "lang", spaced.alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.when(F.col("size") == 2, F.col("n2")).otherwise(F.col("r1"))).otherwise(F.col("n3")).alias("r"),
        F.when(early, F.col("s1")).otherwise(F.col("s2")).alias("score"), "cut",
    )
    best = ranked(written(scored, "phrase-scored"), top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def ranked(scored: DataFrame, top: int, share: int = 1 << 18) -> DataFrame:
    """The first `top` rows of each language with their rank: first within shares of about `share` rows, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shares = -(-scored.count() // share) or 1
    place = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    near = scored.withColumn("_share", place).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return near.drop("_share").withColumn("rank", rank).filter(F.col("rank") <= top)
